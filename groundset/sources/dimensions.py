"""Constant dimension tables: regions and never-fetched hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Region code, name, search region, language hint, currency hint.
REGIONS = (
    ("GLOBAL", "Worldwide", None, None, None),
    ("IN", "India", "in", "en", "INR"),
    ("US", "United States", "us", "en", "USD"),
    ("GB", "United Kingdom", "gb", "en", "GBP"),
    ("CA", "Canada", "ca", "en", "CAD"),
    ("AU", "Australia", "au", "en", "AUD"),
    ("SG", "Singapore", "sg", "en", "SGD"),
    ("AE", "United Arab Emirates", "ae", "en", "AED"),
    ("DE", "Germany", "de", "de", "EUR"),
    ("FR", "France", "fr", "fr", "EUR"),
    ("NL", "Netherlands", "nl", "nl", "EUR"),
    ("JP", "Japan", "jp", "ja", "JPY"),
)

# Hosts the policy never fetches.
BLOCKED_HOSTS = (
    "linkedin.com", "www.linkedin.com", "facebook.com", "www.facebook.com",
    "instagram.com", "www.instagram.com", "x.com", "www.x.com",
    "twitter.com", "www.twitter.com", "tiktok.com", "www.tiktok.com",
    "pinterest.com", "www.pinterest.com", "reddit.com", "www.reddit.com",
    "youtube.com", "www.youtube.com", "m.youtube.com", "youtu.be",
)

# Fixed value: the product token robots rules are matched with.
AGENT = "groundsetbot"


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        REGIONS,
        "code string, name string, search_region string, language_hint string, currency_hint string",
    )


def with_region(df: DataFrame, code: str = "region") -> DataFrame:
    """Look a region code up, upper-cased and trimmed; unknown or empty becomes GLOBAL.

    The dimension has twelve rows, so it is broadcast.
    """
    dim = regions(df.sparkSession).select(
        F.col("code").alias("region_code"), F.col("name").alias("region_name"),
        "search_region", "language_hint", "currency_hint",
    )
    wanted = F.upper(F.trim(F.col(code)))
    known = F.when(wanted.isin(*[r[0] for r in REGIONS]), wanted).otherwise("GLOBAL")
    return df.withColumn("region_code", known).join(F.broadcast(dim), "region_code")
