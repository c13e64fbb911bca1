"""URL expressions on the generic URI grammar (RFC 3986, appendix B)."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundset.functions.text import strip

_URI = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"
)
_SCHEME, _AUTHORITY, _PATH, _QUERY = 1, 3, 4, 6


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URI, group)


def _lenient(url: Column) -> Column:
    """What URL parsers drop first: leading controls and blanks, inner tabs and newlines."""
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def scheme(url: Column) -> Column:
    return F.lower(_part(_lenient(url), _SCHEME))


def host(url: Column) -> Column:
    """Lower-case host without user info, port or brackets; '' when there is none."""
    authority = F.regexp_replace(_part(_lenient(url), _AUTHORITY), r"^.*@", "")
    bracketed = F.regexp_extract(authority, r"^\[([^\]]*)\]", 1)
    plain = F.substring_index(authority, ":", 1)
    return F.lower(F.when(authority.startswith("["), bracketed).otherwise(plain))


def base_domain(host_name: Column) -> Column:
    """Last two labels of a host."""
    return F.substring_index(host_name, ".", -2)


def path(url: Column) -> Column:
    return _part(_lenient(url), _PATH)


def path_and_query(url: Column) -> Column:
    """Path with query, as robots rules are matched."""
    url = _lenient(url)
    return F.concat(
        F.when(_part(url, _PATH) == "", "/").otherwise(_part(url, _PATH)),
        F.regexp_extract(url, _URI, 5),
    )


def _form_decoded(value: Column) -> Column:
    return F.coalesce(F.try_url_decode(value), F.replace(value, F.lit("+"), F.lit(" ")))


def _form_encoded(value: Column) -> Column:
    encoded = F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A"))
    return F.replace(encoded, F.lit("%7E"), F.lit("~"))


def clean_query(query: Column) -> Column:
    """Form-encoded query without blank values and `utm_*` names; repeats of a name move together."""
    pairs = F.transform(
        F.split(query, "&"),
        lambda p: F.struct(
            _form_decoded(F.substring_index(p, "=", 1)).alias("name"),
            F.when(p.contains("="), _form_decoded(F.regexp_replace(p, r"^[^=]*=", "")))
            .otherwise("").alias("value"),
        ),
    )
    kept = F.filter(pairs, lambda p: (p["value"] != "") & ~p["name"].startswith("utm_"))
    placed = F.transform(
        kept,
        lambda p, i: F.struct(
            F.array_position(F.transform(kept, lambda k: k["name"]), p["name"]).alias("first"),
            i.alias("at"),
            F.concat(_form_encoded(p["name"]), F.lit("="), _form_encoded(p["value"])).alias("text"),
        ),
    )
    return F.array_join(F.transform(F.array_sort(placed), lambda p: p["text"]), "&")


def _rebuilt(url: Column, lower_case: bool) -> Column:
    """The URL with cleaned query and no fragment."""
    url = _lenient(url)
    authority = _part(url, _AUTHORITY)
    query = clean_query(_part(url, _QUERY))
    url_scheme = F.lower(_part(url, _SCHEME))
    return F.concat(
        F.when(url_scheme != "", F.concat(url_scheme, F.lit(":"))).otherwise(""),
        F.when(authority != "", F.concat(F.lit("//"), F.lower(authority) if lower_case else authority))
        .otherwise(""),
        _part(url, _PATH),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def _without_dots(url_path: Column) -> Column:
    """Resolve `.` and `..` segments."""
    segments = F.split(url_path, "/")
    last = F.element_at(segments, -1)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
        .when(s == ".", acc)
        .otherwise(F.array_append(acc, s)),
    )
    return F.concat(
        F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    )


def resolve(base: Column, reference: Column) -> Column:
    """A relative reference against a base URL."""
    reference = _lenient(reference)
    root = F.concat(_part(base, _SCHEME), F.lit("://"), _part(base, _AUTHORITY))
    base_path = _part(base, _PATH)
    folder = F.when(base_path == "", "/").otherwise(F.regexp_replace(base_path, r"[^/]*$", ""))
    query = F.regexp_extract(reference, _URI, 5)
    ref_path = _part(reference, _PATH)
    return (
        F.when(_part(reference, _SCHEME) != "", reference)
        .when(reference.startswith("//"), F.concat(_part(base, _SCHEME), F.lit(":"), reference))
        .when(ref_path.startswith("/"), F.concat(root, _without_dots(ref_path), query))
        .when(
            ref_path == "",
            F.concat(root, base_path, F.when(query != "", query).otherwise(F.regexp_extract(base, _URI, 5))),
        )
        .otherwise(F.concat(root, _without_dots(F.concat(folder, ref_path)), query))
    )


def _is_http(url: Column) -> Column:
    return F.lower(url).startswith("http://") | F.lower(url).startswith("https://")


def normalize_url(value: Column, base: Column | None = None) -> Column:
    """`struct<url, valid>`: http(s) cleaned, relative kept or resolved, other schemes null."""
    given = strip(value)
    http = _is_http(given)
    if base is None:
        dangerous = given.contains(":") & ~given.startswith("/")
        url = F.when(http, _rebuilt(given, True)).when(~dangerous, given)
        valid = http | ~dangerous
    else:
        full = F.when(http, given).otherwise(resolve(base, given))
        valid = scheme(full).isin("http", "https")
        url = F.when(valid, _rebuilt(full, True))
    blank = value.isNull() | (value == "")
    return F.struct(
        F.when(~blank, url).alias("url"), (blank | F.coalesce(valid, F.lit(False))).alias("valid")
    )


def canonical_url(value: Column) -> Column:
    """Candidate form: tracking parameters and fragment dropped, case of the host kept."""
    return _rebuilt(value, False)


def safe_href(value: Column) -> Column:
    """Absolute http(s) link or null, after dropping characters browsers ignore."""
    url = strip(F.regexp_replace(value, r"[\t\n\r\x00]", ""))
    name = host(url)
    rest = F.regexp_replace(url, r"(?s)^[^:]*://[^/?#]*", "")
    port = F.regexp_extract(_part(url, _AUTHORITY), r":(\d+)$", 1)
    default_port = F.when(scheme(url) == "http", "80").otherwise("443")
    shown = F.when(name.contains(":"), F.concat(F.lit("["), name, F.lit("]"))).otherwise(name)
    link = F.concat(
        scheme(url), F.lit("://"), shown,
        F.when((port != "") & (port != default_port), F.concat(F.lit(":"), port)).otherwise(""),
        F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)),
    )
    return F.when(_is_http(url) & (name != "") & ~name.rlike(r"[\s<>^|%]"), link)


# Address blocks that are never fetched, from the IANA special-purpose registry
# plus multicast; and the two addresses inside them that are global.
IPV4_BLOCKS = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
    "224.0.0.0/4", "240.0.0.0/4",
)
IPV4_GLOBAL = ("192.0.0.9", "192.0.0.10")

# The same blocks by their leading octets, so that one pattern decides.
_PRIVATE_IPV4 = (
    r"^(?:0|10|127|22[4-9]|23\d|24\d|25[0-5])\.|^169\.254\.|^172\.(?:1[6-9]|2\d|3[01])\."
    r"|^192\.168\.|^192\.0\.[02]\.|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\."
)

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def is_ipv4(name: Column) -> Column:
    return name.rlike(_IPV4)


def is_private_ipv4(name: Column) -> Column:
    return is_ipv4(name) & name.rlike(_PRIVATE_IPV4) & ~name.isin(*IPV4_GLOBAL)


@F.pandas_udf(T.StringType())
def _ipv6_class(names: pd.Series) -> pd.Series:
    def classify(name):
        try:
            ip = ipaddress.ip_address(name)
        except ValueError:
            return "name"
        special = (
            ip.is_private or ip.is_loopback or ip.is_link_local
            or ip.is_reserved or ip.is_multicast or ip.is_unspecified
        )
        return "private" if special else "public"

    return names.map(classify, na_action="ignore")


_ipv6_class = _ipv6_class.asNondeterministic()


def address_class(name: Column, ipv6: bool = True) -> Column:
    """'private' or 'public' for address literals, 'name' for anything else.

    Only hosts holding a colon can be IPv6 and reach Python; without `ipv6` they count as names.
    """
    native = F.when(is_ipv4(name), F.when(is_private_ipv4(name), "private").otherwise("public"))
    if not ipv6:
        return native.otherwise("name")
    has_colon = name.contains(":")
    return native.when(has_colon, _ipv6_class(F.when(has_colon, name))).otherwise("name")
