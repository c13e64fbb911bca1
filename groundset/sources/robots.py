"""robots.txt texts to rule rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundset.functions.text import strip
from groundset.sources.dimensions import AGENT


def robots_rules(texts: DataFrame, agent: str = AGENT) -> DataFrame:
    """`(host, text, http_status)` to the rules `(host, rule_idx, allow, path_prefix)` that bind
    the agent: its own group, else the first `*` group. Hosts without a 200 answer give no rule.

    Windows run over the lines of one file.
    """
    lines = (
        texts.filter((F.col("http_status") == 200) & F.col("text").isNotNull())
        .select("host", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("n", "raw"))
        .withColumn("line", strip(F.substring_index("raw", "#", 1)))
        .withColumn("name", F.lower(strip(F.substring_index("line", ":", 1))))
        .withColumn("value", strip(F.regexp_replace("line", r"(?s)^[^:]*:?", "")))
        .withColumn(
            "kind",
            F.when(F.col("raw") == "", "blank")
            .when(~F.col("line").contains(":"), None)
            .when(F.col("name") == "user-agent", "agent")
            .when(F.col("name").isin("allow", "disallow", "crawl-delay", "request-rate"), "rule"),
        )
        .filter(F.col("kind").isNotNull())
    )
    order = Window.partitionBy("host").orderBy("n")
    starts = (F.col("kind") == "blank") | (
        (F.col("kind") == "agent") & (F.lag("kind").over(order) == "rule")
    )
    lines = lines.withColumn("starts", F.coalesce(starts, F.lit(False)).cast("int"))
    lines = lines.withColumn("grp", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    in_group = Window.partitionBy("host", "grp")
    is_agent = F.col("kind") == "agent"
    named = F.when(is_agent, F.lower("value"))
    lines = (
        lines.withColumn("agent_line", F.min(F.when(is_agent, F.col("n"))).over(in_group))
        .withColumn("has_rule", F.bool_or((F.col("kind") == "rule") & (F.col("n") > F.col("agent_line"))).over(in_group))
        .withColumn("wild", F.bool_or(named == "*").over(in_group))
        .withColumn("own", F.bool_or(F.lit(agent.split("/")[0].lower()).contains(named)).over(in_group))
        .filter("has_rule")
    )
    per_host = Window.partitionBy("host")
    own_group = F.min(F.when(F.col("own") & ~F.col("wild"), F.col("grp"))).over(per_host)
    wild_group = F.min(F.when(F.col("wild"), F.col("grp"))).over(per_host)
    chosen = lines.withColumn("chosen", F.coalesce(own_group, wild_group)).filter("grp = chosen")
    rules = chosen.filter(F.col("name").isin("allow", "disallow") & (F.col("n") > F.col("agent_line")))
    return rules.select(
        "host",
        F.col("n").alias("rule_idx"),
        ((F.col("name") == "allow") | (F.col("value") == "")).alias("allow"),
        F.col("value").alias("path_prefix"),
    )
