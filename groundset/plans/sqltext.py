"""SQL text pieces shared by the comparison queries (DuckDB dialect)."""

from __future__ import annotations

from groundset.functions import text
from groundset.functions.urls import IPV4_BLOCKS
from groundset.sources.dimensions import BLOCKED_HOSTS

SP = r"[\s\x1c-\x1f\x{85}\p{Z}]+"
NOT_WORD = r"[^\p{L}\p{N}_\s\x1c-\x1f\x{85}\p{Z}]"
URI = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SP}', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}|{SP}$', '', 'g')"


def norm(x: str) -> str:
    """Comparison form for texts NFKC leaves alone and without entities."""
    folded = f"replace(coalesce({x}, ''), chr(8230), '...')"
    for code, char in text._FOLDED.items():
        folded = f"replace({folded}, chr({code}), '{char.replace(chr(39), chr(39) * 2)}')"
    return f"lower({collapse(folded)})"


def plain(x: str) -> str:
    return collapse(f"regexp_replace({x}, '{NOT_WORD}', ' ', 'g')")


def key_text(x: str) -> str:
    words = "|".join(text.LEGAL_WORDS)
    bare = rf"regexp_replace(lower({strip(f'coalesce({x}, {chr(39) * 2})')}), '\b(?:{words})\b', '', 'g')"
    return collapse(f"regexp_replace({bare}, '{NOT_WORD}', '', 'g')")


def dedupe_key(*parts: str) -> str:
    return f"substring(sha256(concat_ws('|', {', '.join(parts)})), 1, 16)"


def sorted_tokens(x: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split({x}, ' '), lambda t: t <> '')), ' ')"


def visible(x: str) -> str:
    out = f"regexp_replace(regexp_replace({x}, '{text._BREAKS}', chr(10), 'g'), '{text._TAGS}', '', 'g')"
    for entity, char in text._ENTITIES:
        out = f"replace({out}, '{entity}', chr({ord(char)}))"
    out = rf"regexp_replace({out}, '[ \t\r\f]+', ' ', 'g')"
    return rf"regexp_replace(regexp_replace({out}, ' ?\n ?', chr(10), 'g'), '^\n+|\n+$', '', 'g')"


def main_text(x: str) -> str:
    article = rf"regexp_extract({x}, '(?is)<article\b[^>]*>(.*?)</article\s*>', 1)"
    body = f"case when {article} <> '' then {article} else {x} end"
    return visible(f"regexp_replace({body}, '{text._NOISE}', '', 'g')")


def usable_text(x: str, limit: int | None = None) -> str:
    whole = visible(f"regexp_replace({x}, '{text._INVISIBLE}', '', 'g')")
    body = f"case when length({strip(main_text(x))}) < 80 then {whole} else {main_text(x)} end"
    kept = f"case when length({strip(body)}) >= 50 then {body} end"
    return kept if limit is None else f"substring({kept}, 1, {limit})"


def first_paragraph(x: str) -> str:
    found = rf"regexp_extract_all({x}, '(?is)<p(?:\s[^>]*)?>(.*?)</p\s*>', 1)"
    return f"list_filter(list_transform({found}, lambda p: {visible('p')}), lambda p: p <> '')[1]"


def scheme(x: str) -> str:
    return f"lower(regexp_extract({x}, '{URI}', 1))"


def host(x: str) -> str:
    return f"lower(split_part(regexp_replace(regexp_extract({x}, '{URI}', 3), '^.*@', ''), ':', 1))"


def base_domain(h: str) -> str:
    return f"array_to_string(string_split({h}, '.')[-2:], '.')"


def rebuilt(x: str, lower_case: bool) -> str:
    """Cleaned URL, for query strings without repeats or escapes."""
    authority = f"regexp_extract({x}, '{URI}', 3)"
    kept = (
        f"list_filter(string_split(regexp_extract({x}, '{URI}', 6), '&'), "
        "lambda p: split_part(p, '=', 2) <> '' and not starts_with(p, 'utm_'))"
    )
    query = f"array_to_string({kept}, '&')"
    shown = f"lower({authority})" if lower_case else authority
    return (
        f"(case when {scheme(x)} <> '' then {scheme(x)} || ':' else '' end"
        f" || case when {authority} <> '' then '//' || {shown} else '' end"
        f" || regexp_extract({x}, '{URI}', 4) || case when {query} <> '' then '?' || {query} else '' end)"
    )


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def policy_reason(url: str, blocked=BLOCKED_HOSTS, disallowed: str = "false") -> str:
    import ipaddress

    h = host(url)
    octets = f"string_split({h}, '.')"
    number = " + ".join(f"coalesce(try_cast({octets}[{i + 1}] as bigint), 0) * {256 ** (3 - i)}" for i in range(4))
    nets = [ipaddress.ip_network(b) for b in IPV4_BLOCKS]
    inside = " or ".join(
        f"({number}) between {int(n.network_address)} and {int(n.broadcast_address)}" for n in nets
    )
    private = rf"(regexp_matches({h}, '^\d+\.\d+\.\d+\.\d+$') and ({inside}))"
    return (
        f"case when {scheme(url)} not in ('http', 'https') then 'Unsupported scheme: ' || {scheme(url)}"
        f" when {h} = '' then 'No hostname in URL'"
        f" when {h} in ({quoted(blocked)}) or {base_domain(h)} in ({quoted(blocked)}) then 'Blocked domain: ' || {h}"
        f" when {private} then 'Private/loopback/link-local IP'"
        f" when {disallowed} then 'Disallowed by robots.txt' else 'OK' end"
    )


def safe_cell(x: str) -> str:
    return rf"case when regexp_matches({x}, '^[ \t\r\n]*[=+\-@%]') then '''' || {x} else {x} end"
