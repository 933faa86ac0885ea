"""Analyst queries and privacy rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smishlake.functions import constants as C

HIGH_RISK = 80


def overview(analyses: DataFrame) -> DataFrame:
    """Totals in one row."""
    high = F.count_if(F.col("risk_score") >= HIGH_RISK)
    n = F.count(F.lit(1))
    return analyses.agg(n.alias("n_messages"), high.alias("n_high_risk"), F.bround(100.0 * high / F.greatest(F.lit(1), n), 1).alias("pct_high_risk"))


def histograms(analyses: DataFrame) -> DataFrame:
    """Counts by family and by language from one pass."""
    out = analyses.groupingSets([["scam_family"], ["language"]], "scam_family", "language").agg(F.grouping("scam_family").alias("_g"), F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("_g") == 0, "family").otherwise("language")
    return out.select(kind.alias("kind"), F.coalesce("scam_family", "language").alias("name"), "n")


def risk_levels(analyses: DataFrame) -> DataFrame:
    return analyses.groupBy("scam_family", "risk_level").agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg("risk_score"), 2).alias("avg_risk"))


def messages_page(analyses: DataFrame, family: str | None = None, min_risk: int = 0, limit: int = 20, offset: int = 0) -> DataFrame:
    """Newest messages of a family (any case) at or above a risk."""
    df = analyses.filter(F.col("risk_score") >= min_risk)
    df = df.filter(F.lower("scam_family") == family.lower()) if family else df
    return df.orderBy(F.desc("received_at"), F.desc("msg_id")).offset(offset).limit(limit)


def of_type(indicators: DataFrame, kind: str) -> DataFrame:
    return indicators.filter(F.col("type") == kind)


def top_indicators(rolled: DataFrame, k: int) -> DataFrame:
    return rolled.orderBy(F.desc("n"), "type", "value").limit(k)


def redact(c: Column) -> Column:
    """Without the values of key=value secrets and bearer tokens."""
    for pattern, new in C.SECRETS:
        c = F.regexp_replace(c, pattern, new)
    return c


def scrub_old(messages: DataFrame, cutoff: Column) -> DataFrame:
    """Text and sender of messages before the cutoff become null; ids and other columns stay."""
    old = F.col("received_at") < cutoff
    return messages.withColumns({c: F.when(old, None).otherwise(F.col(c)) for c in ("raw_text", "sender_id")})


def without_text(df: DataFrame) -> DataFrame:
    return df.drop("raw_text", "normalized_text", "text", "transformations")
