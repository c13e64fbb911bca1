"""Source policy: scheme, block list, private addresses, robots rules, redirects, politeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundset.functions import urls
from groundset.operators.skew import ROWS_PER_TASK, join_spread, with_prefix
from groundset.sources.dimensions import BLOCKED_HOSTS

# Status names and limits.
MAX_REDIRECTS = 3
DOMAIN_DELAY_SECONDS = 2.0


def is_blocked_host(host: Column, blocked: tuple[str, ...] = BLOCKED_HOSTS) -> Column:
    return host.isin(*blocked) | urls.base_domain(host).isin(*blocked)


def host_facts(robots_rules: DataFrame | None, dns: DataFrame | None) -> DataFrame | None:
    """One row per host: its robots rules in order (as long as its robots.txt) and whether any of
    its addresses is private."""
    parts = []
    if robots_rules is not None:
        rule = F.struct("rule_idx", "allow", "path_prefix")
        parts.append(robots_rules.groupBy("host").agg(F.array_sort(F.collect_list(rule)).alias("rules")))
    if dns is not None:
        classed = dns.select("host", (urls.address_class(F.col("ip")) != "public").alias("private"))
        parts.append(classed.groupBy("host").agg(F.bool_or("private").alias("resolves_private")))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].join(parts[1], "host", "full")


def robots_allows(rules: Column, path: Column) -> Column:
    """Allowance of the first rule whose prefix the path has; no rule allows."""
    hits = F.filter(rules, lambda r: (r["path_prefix"] == "*") | path.startswith(r["path_prefix"]))
    return F.coalesce(F.try_element_at(hits, F.lit(1))["allow"], F.lit(True))


def with_policy(
    df: DataFrame,
    url: str = "url",
    robots_rules: DataFrame | None = None,
    dns: DataFrame | None = None,
    blocked: tuple[str, ...] = BLOCKED_HOSTS,
    ipv6: bool = True,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add `host`, `allowed` and `reason`, the first rule of the policy a URL fails.

    With a `dns(host, ip)` table, names that resolve to a private address, or not at all, are
    blocked; without one, names pass. Rules and addresses come in one row per host, so the join
    neither multiplies URLs nor needs a second shuffle to collapse them.
    """
    facts = host_facts(robots_rules, dns)
    df = df.withColumn("host", F.coalesce(urls.host(F.col(url)), F.lit("")))
    if facts is not None:
        df = join_spread(df, facts, ["host"], [url], "left", rows_per_task)
    address = urls.address_class(F.col("host"), ipv6)
    private = address == "private"
    if dns is not None:
        private = private | ((address == "name") & F.coalesce("resolves_private", F.lit(True)))
    disallowed = F.lit(False)
    if robots_rules is not None:
        disallowed = ~robots_allows(F.col("rules"), urls.path_and_query(F.col(url)))
    scheme = F.coalesce(urls.scheme(F.col(url)), F.lit(""))
    # Reason texts.
    reason = (
        F.when(~scheme.isin("http", "https"), F.concat(F.lit("Unsupported scheme: "), scheme))
        .when(F.col("host") == "", "No hostname in URL")
        .when(is_blocked_host(F.col("host"), blocked), F.concat(F.lit("Blocked domain: "), F.col("host")))
        .when(private, "Private/loopback/link-local IP")
        .when(disallowed, "Disallowed by robots.txt")
        .otherwise("OK")
    )
    df = df.withColumn("reason", reason).withColumn("allowed", F.col("reason") == "OK")
    return df.drop("rules", "resolves_private")


def blocked_status(reason: Column) -> Column:
    return F.when(F.lower(reason).contains("robots"), "blocked_by_robots").otherwise("blocked_by_policy")


def check_redirects(redirects: DataFrame, max_redirects: int = MAX_REDIRECTS, **policy) -> DataFrame:
    """Per requested `url` with hops `(url, hop, target)`: the first blocked hop or too many hops.

    Gives `n_hops`, `final_url`, `reason` (null when the chain may be followed).
    """
    checked = with_policy(redirects, "target", **policy)
    block = F.when(
        ~F.col("allowed"),
        F.concat(F.lit("Redirect blocked: "), F.col("reason"), F.lit(" ("), F.col("target"), F.lit(")")),
    )
    chains = checked.groupBy("url").agg(
        F.count(F.lit(1)).alias("n_hops"),
        F.max_by("target", "hop").alias("final_url"),
        F.min_by(block, F.when(~F.col("allowed"), F.col("hop"))).alias("blocked"),
        F.min(F.when(~F.col("allowed"), F.col("hop"))).alias("blocked_hop"),
    )
    # Hops are followed up to the limit; a block further on is never reached.
    too_many = F.when(F.col("n_hops") > max_redirects, "Too many redirects")
    reached = F.when(F.col("blocked_hop") <= max_redirects + 1, F.col("blocked"))
    return chains.select("url", "n_hops", "final_url", F.coalesce(reached, too_many).alias("reason"))


def fetch_schedule(
    requests: DataFrame,
    delay: float = DOMAIN_DELAY_SECONDS,
    key: str = "host",
    arrival: str = "arrival_s",
    tie: str = "request_id",
) -> DataFrame:
    """Earliest polite fetch time per request: `delay` seconds after the previous one of its key.

    Closed form of the sequential rule: with i the position in the key, the slot is
    max over j <= i of (arrival_j - j*delay) + i*delay.
    """
    numbered = with_prefix(requests, [key], [arrival, tie], count="_i")
    lead = F.col(arrival) - F.col("_i") * delay
    scanned = with_prefix(numbered, [key], [arrival, tie], running_max={"_lead": lead})
    return scanned.select(*requests.columns, (F.col("_lead") + F.col("_i") * delay).alias("fetch_s"))
