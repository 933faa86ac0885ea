"""Manipulation scores, family, risk and recommended action of messages; the whole analysis of a message in one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smishlake.functions import constants as C
from smishlake.functions.columns import barrier
from smishlake.operators.brands import match_brands
from smishlake.operators.evidence import detect_evidence
from smishlake.operators.signals import PARTS, cleaned_and_scanned, score_bit, with_signals
from smishlake.operators.text import normalize

PROFILE = ("fear", "urgency", "authority", "financial", "credential", "link", "call_to_action")


def score_messages(df: DataFrame) -> DataFrame:
    """Adds the seven manipulation scores, scam_family, risk_score, risk_level, recommended_action and decoded_meaning.

    Patterns have no word boundaries; links are looked for in the raw text, calls to action in the normalised text.
    """
    given = "_signals" in df.columns
    df = with_signals(df, ("scores",))
    family = F
    for name, _, _ in C.FAMILIES:
        family = family.when(score_bit(f"family_{name}"), F.lit(name))
    zero = F.lit(0.0)
    df = df.withColumn("fear", F.when(score_bit("fear_high"), 0.90).when(score_bit("fear_low"), 0.65).otherwise(zero))
    df = df.withColumn("urgency", F.when(score_bit("urgency"), 0.85).otherwise(zero))
    df = df.withColumn("scam_family", family.otherwise("SAFE"))
    scores = {name: score for name, _, score in C.FAMILIES}
    df = df.withColumn("authority", F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in scores.items() for x in kv)), F.col("scam_family")), zero))
    df = df.withColumn("credential", F.when(score_bit("credential"), 0.95).otherwise(zero)).withColumn("financial", F.when(score_bit("financial"), 0.80).otherwise(zero))
    df = df.withColumn("link", F.when(score_bit("link"), 0.90).otherwise(zero)).withColumn("call_to_action", F.when(score_bit("call_to_action"), 0.85).otherwise(zero))
    weights = F.array("fear", "urgency", "authority", F.col("credential") * 1.2, F.col("link") * 1.1, F.col("call_to_action") * 0.8)
    active = F.filter(weights, lambda w: w > 0)
    df = barrier(df.withColumn("_active", active), *PROFILE, "scam_family", "_active")
    safe = (F.col("fear") == 0) & (F.col("link") == 0) & (F.col("credential") == 0) & (F.col("authority") == 0)
    raw = (F.aggregate("_active", zero, lambda a, w: a + w) / F.size("_active") * 0.4 + F.array_max("_active") * 0.6) * 100
    raw = F.when(F.col("n_transformations") > 0, F.least(F.lit(100.0), raw + F.least(F.lit(15.0), F.col("n_transformations") * 5.0))).otherwise(raw)
    df = df.withColumn("_safe", safe).withColumn("risk_score", F.when(safe, 5).otherwise(F.least(F.lit(100.0), F.greatest(zero, F.bround(raw, 0))).cast("int")))
    df = df.withColumn("scam_family", F.when(F.col("_safe"), "SAFE").otherwise(F.col("scam_family")))
    risk = F.col("risk_score")
    df = df.withColumn("risk_level", F.when(F.col("_safe"), "SAFE").when(risk >= 80, "CRITICAL").when(risk >= 60, "HIGH").when(risk >= 35, "MEDIUM").otherwise("LOW"))
    action = F.when(F.col("_safe"), "NO_ACTION").when(F.col("credential") > 0.5, "DO_NOT_SHARE_OTP").when(F.col("link") > 0.5, "OPEN_OFFICIAL_APP_OR_SITE").otherwise("VERIFY_WITH_OFFICIAL_SUPPORT")
    df = df.withColumn("recommended_action", action)
    meaning = F.format_string("Tries to cause %s over your %s so that you act at once.", F.when(F.col("fear") > 0.5, "fear and hurry").otherwise("action"), F.when(F.col("scam_family") != "SAFE", F.col("scam_family")).otherwise("account"))
    df = df.withColumn("decoded_meaning", F.when(F.col("_safe"), "No sign of manipulation.").otherwise(meaning))
    df = barrier(df.drop("_active", "_safe"), "scam_family", "risk_score", "risk_level", "recommended_action", "decoded_meaning")
    return df if given else df.drop("_signals")


def trigger_words(df: DataFrame) -> DataFrame:
    """Adds facts: links and phone numbers of the raw text, and the distinct trigger words, sorted."""
    raw = F.lower(F.coalesce("raw_text", F.lit("")))
    return df.withColumn("facts", F.struct(
        F.array_sort(F.array_distinct(F.regexp_extract_all(raw, F.lit(r"https?://\S+"), F.lit(0)))).alias("links"),
        F.array_sort(F.array_distinct(F.regexp_extract_all(raw, F.lit(rf"(?<![0-9]){C.PHONE}(?![0-9])"), F.lit(1)))).alias("phones"),
        F.array_sort(F.array_distinct(F.regexp_extract_all(raw, F.lit(f"(?:{C.FEAR_HIGH}|{C.CREDENTIAL})"), F.lit(0)))).alias("words")))


def analyze_messages(messages: DataFrame, max_chars: int | None = None, parts: tuple[str, ...] = PARTS, log: bool = True, keep_text: bool = True, vectors: Callable | None = None) -> DataFrame:
    """messages(msg_id, raw_text, sender_id, ...) with everything that is known of each message; no shuffle.

    parts names what is wanted: scores, brands, evidence (which needs the other two). Normalisation and all of them are
    one pass over the texts. Without log the transformations are counted, but not listed; without keep_text there is no
    normalized_text. vectors (such as campaigns.unit_counts) adds embedding in the same pass.
    """
    df = normalize(messages, log=log, passes=cleaned_and_scanned(parts, log, max_chars, keep_text, vectors), keep_text=keep_text, vectors=vectors is not None)
    if "scores" in parts:
        df = score_messages(df)
    if "brands" in parts:
        df = match_brands(df)
    if "evidence" in parts:
        df = detect_evidence(df, "scam_family")
    return df.drop("_signals")
