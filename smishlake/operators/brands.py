"""Brand impersonation against a registry of trusted organisations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from smishlake.functions import constants as C
from smishlake.functions.columns import barrier, text_literals
from smishlake.operators.signals import with_signals


def organisations(spark: SparkSession) -> DataFrame:
    """The registry as a dimension; ord is the order of precedence."""
    rows = [(i, *map(lambda x: list(x) if isinstance(x, tuple) else x, o)) for i, o in enumerate(C.ORGANISATIONS)]
    return spark.createDataFrame(rows, T.StructType.fromDDL("ord int, org_id string, name string, aliases array<string>, domains array<string>, sender_headers array<string>, category string, support_url string"))


def find_by_alias(df: DataFrame, text_col: str) -> DataFrame:
    """Adds org_id of the first organisation of which an alias is contained in a text (null if none), and n_orgs."""
    return _first(df, [_any(F.lower(F.col(text_col)), [a.lower() for a in o[2]]) for o in C.ORGANISATIONS])


def find_by_domain(df: DataFrame, host_col: str) -> DataFrame:
    """Adds org_id of the first organisation that owns a host or a parent of it, and n_orgs."""
    host = F.col(host_col)
    return _first(df, [F.exists(text_literals(o[3]), lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d))) for o in C.ORGANISATIONS])


def _first(df: DataFrame, hits: list[Column]) -> DataFrame:
    """A projection: the registry is a handful of literals, in order of precedence. Every row stays, repeated ones too."""
    df = df.withColumn("_orgs", F.array_compact(F.array(*(F.when(h, F.lit(o[0])) for h, o in zip(hits, C.ORGANISATIONS, strict=True)))))
    return df.withColumn("org_id", F.get("_orgs", F.lit(0))).withColumn("n_orgs", F.size("_orgs")).drop("_orgs")


def _org_literal(i: int) -> Column:
    o = C.ORGANISATIONS[i]
    return F.struct(F.lit(i).alias("ord"), F.lit(o[0]).alias("org_id"), F.lit(o[1]).alias("name"), text_literals(o[2]).alias("aliases"), text_literals(o[3]).alias("domains"), text_literals(o[4]).alias("sender_headers"), F.lit(o[5]).alias("category"), F.lit(o[6]).alias("support_url"))


def _any(text: Column, values) -> Column:
    return F.exists(text_literals(values), lambda v: F.contains(text, v))


def claimed(bits: Column, header: Column) -> Column:
    """Ordinals of the organisations that a message speaks for: an alias as a word of the clean text or anywhere in the
    raw one (both in bits), or a known header in the sender id."""
    out = [F.when((F.getbit(bits, F.lit(i)) == 1) | F.coalesce(_any(header, o[4]), F.lit(False)), F.lit(i)) for i, o in enumerate(C.ORGANISATIONS)]
    return F.array_compact(F.array(*out))


def match_brands(df: DataFrame) -> DataFrame:
    """Adds claimed_brand, impersonation_detected, brand_confidence and reference to messages(raw_text, normalized_text, sender_id).

    A projection without a shuffle: the registry is ten literals. Rules in their order: no claim; a look-alike link or a
    foreign sender header; threat without an official link; else a neutral mention, which also undoes a header mismatch.
    """
    given = "_signals" in df.columns
    df = with_signals(df, ("brands",))
    header = F.replace(F.upper(F.nullif(F.col("sender_id"), F.lit(""))), F.lit("-"), F.lit(""))
    df = barrier(df.withColumn("_claims", claimed(F.col("_signals.claims"), header)), "_claims")
    df = df.withColumn("_org", F.get(F.array(*(_org_literal(i) for i in range(len(C.ORGANISATIONS)))), F.get("_claims", F.lit(0))))
    found = F.regexp_extract_all("raw_text", F.lit(f"(?i){C.BRAND_URL}"), F.lit(0))
    bare = lambda u: F.lower(F.trim(F.split_part(F.split_part(F.replace(F.replace(F.replace(u, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")), F.lit("www."), F.lit("")), F.lit("/"), F.lit(1)), F.lit("?"), F.lit(1))))
    df = df.withColumn("_domains", F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), bare), lambda d: d != ""))
    own = F.col("_org.domains")
    legit = lambda d: F.exists(own, lambda x: (d == x) | F.endswith(d, F.concat(F.lit("."), x)))
    fake = lambda d: F.exists("_org.aliases", lambda a: (F.length(a) >= 3) & F.contains(d, F.lower(a))) | d.startswith("xn--") | F.contains(d, F.lit("ın")) | F.contains(d, F.lit("gòog")) | _any(d, C.BRAND_BAD_TLDS)
    df = df.withColumn("has_official_link", F.coalesce(F.exists("_domains", legit), F.lit(False)))
    df = df.withColumn("has_phishing_link", F.coalesce(F.exists("_domains", lambda d: ~legit(d) & fake(d)), F.lit(False)))
    own_header = F.exists("_org.sender_headers", lambda s: F.contains(header, s))
    other = F.lit(False)
    for i, o in enumerate(C.ORGANISATIONS):
        other = other | ((F.col("_org.ord") != i) & _any(header, o[4]))
    df = df.withColumn("sender_mismatch", F.coalesce(header.isNotNull() & ~own_header & other, F.lit(False)))
    df = df.withColumn("has_threat", F.col("_signals.threat"))
    phishing, threat, official, mismatch = F.col("has_phishing_link"), F.col("has_threat"), F.col("has_official_link"), F.col("sender_mismatch")
    neutral = ~phishing & ~threat
    detected = F.when(F.col("_org").isNull(), False).when(phishing | (threat & ~official), True).when(neutral, False).otherwise(phishing | mismatch)
    confidence = F.when(F.col("_org").isNull(), 0.95).when(neutral, 0.90).when(mismatch, 0.98).when(phishing, 0.96).otherwise(0.85)
    df = df.withColumn("claimed_brand", F.col("_org.name")).withColumn("impersonation_detected", detected).withColumn("brand_confidence", confidence)
    reference = F.when(F.col("_org").isNotNull(), F.struct("_org.name", "_org.category", "_org.domains", "_org.sender_headers", "_org.support_url"))
    made = ["has_official_link", "has_phishing_link", "sender_mismatch", "has_threat", "claimed_brand", "impersonation_detected", "brand_confidence", "reference"]
    df = barrier(df.withColumn("reference", reference).drop("_claims", "_org", "_domains"), *made)
    return df if given else df.drop("_signals")
