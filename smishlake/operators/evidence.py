"""Evidence detectors over raw and normalised text, risk from severities, category and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smishlake.functions import constants as C
from smishlake.functions.columns import barrier, half_even
from smishlake.operators.signals import with_signals

ITEM = "struct<evidence_id:string,category:string,severity:double,confidence:double,value:string>"


def _item(category: str, severity, confidence, value: Column, when: Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    ident = F.sha2(F.concat_ws("|", F.col("msg_id").cast("string"), F.lit(category)), 256)
    return F.when(when, F.struct(ident.alias("evidence_id"), F.lit(category).alias("category"), lit(severity).alias("severity"), lit(confidence).alias("confidence"), value.alias("value")))


def detect_evidence(df: DataFrame, family_col: str | None = None, model_confidence: float = 0.85) -> DataFrame:
    """Adds evidence (array), evidence_risk, evidence_tier, evidence_category, evidence_confidence and uncertainty.

    df comes from normalize and match_brands. With family_col, a family other than SAFE is evidence of its own and
    decides the category. Evidence ids follow from msg_id and category. A span is what its pattern finds first in the
    normalised text, else in the raw text.
    """
    given = "_signals" in df.columns
    df = with_signals(df, ("evidence",))
    items = []
    for i, (category, _, severity, confidence, case, _) in enumerate(C.EVIDENCE):
        span = F.get("_signals.spans", F.lit(i))
        items.append(_item(category, severity, confidence, F.upper(span) if case == "upper" else F.lower(span), span.isNotNull()))
    hit = F.col("impersonation_detected")
    brand = _item("BANK_IMPERSONATION", F.when(hit, 40.0).otherwise(18.0), F.when(hit, F.col("brand_confidence")).otherwise(0.70), F.upper("claimed_brand"), F.col("claimed_brand").isNotNull())
    n = F.col("n_transformations")
    obfuscation = _item("OBFUSCATION_DETECTED", 20.0, 0.89, F.concat(F.lit("count="), n.cast("string")), n > 0)
    found = F.array_compact(F.array(*items[:2], brand, *items[2:], obfuscation))
    if family_col:
        family = F.col(family_col)
        kind = F.when(family.contains("KYC"), "BANK_IMPERSONATION").otherwise("URGENCY_LANGUAGE")
        ident = F.sha2(F.concat_ws("|", F.col("msg_id").cast("string"), F.lit("model")), 256)
        model = F.struct(ident.alias("evidence_id"), kind.alias("category"), F.lit(30.0).alias("severity"), F.lit(model_confidence).alias("confidence"), family.alias("value"))
        found = F.when(family != "SAFE", F.concat(found, F.array(model))).otherwise(found)
    df = barrier(df.withColumn("evidence", found), "evidence")
    total = F.aggregate("evidence", F.lit(0.0), lambda a, e: a + e["severity"])
    df = df.withColumn("evidence_risk", F.least(F.lit(100), F.floor(total).cast("int")))
    risk = F.col("evidence_risk")
    df = df.withColumn("evidence_tier", F.when(risk >= 80, "CRITICAL").when(risk >= 70, "HIGH").when(risk >= 50, "MEDIUM").when(risk >= 20, "LOW").otherwise("SAFE"))
    df = df.withColumn("evidence_category", _category(family_col))
    mean = F.aggregate("evidence", F.lit(0.0), lambda a, e: a + e["confidence"]) / F.size("evidence")
    df = df.withColumn("evidence_confidence", F.when(F.size("evidence") > 0, half_even(mean, 2)).otherwise(0.95))
    df = df.withColumn("uncertainty", half_even(1 - F.col("evidence_confidence"), 2))
    return df if given else df.drop("_signals")


def _category(family_col: str | None) -> Column:
    has = lambda *names: F.exists("evidence", lambda e: e["category"].isin(*names))
    inferred = (
        F.when((F.col("evidence_risk") < 20) | (F.size("evidence") == 0), "SAFE")
        .when(has("BANK_IMPERSONATION", "HOMOGLYPH_DOMAIN"), "BANK_KYC")
        .when(has("UPI_REQUEST"), "UPI_PAYMENT")
        .when(has("REMOTE_ACCESS"), "REMOTE_ACCESS")
        .when(has("OTP_REQUEST", "CREDENTIAL_REQUEST"), "BANK_KYC")
        .otherwise("OTHER_SCAM")
    )
    return F.when(F.col(family_col) != "SAFE", F.col(family_col)).otherwise(inferred) if family_col else inferred


def evidence_long(df: DataFrame) -> DataFrame:
    """One row per message and piece of evidence, in detector order."""
    return df.select("msg_id", F.posexplode("evidence").alias("pos", "e")).select("msg_id", "pos", "e.*")
