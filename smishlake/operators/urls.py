"""Static findings on URLs; nothing is fetched."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from smishlake.functions import constants as C
from smishlake.functions.columns import barrier, text_literals, url_part
from smishlake.operators.indicators import risk_class

FINDING = "struct<finding_id:string,severity:string,confidence:double,detail:string>"
LONG_URL, HIGH_ENTROPY, MANY_LABELS, MANY_ESCAPES = 500, 4.0, 5, 10


@F.pandas_udf(T.StringType())
def nfkc_host(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def entropy(c: Column) -> Column:
    """Shannon entropy of the characters, in bits: per row, without exploding."""
    chars = F.split(c, "")
    n = F.length(c)
    share = F.transform(F.array_sort(F.array_distinct(chars)), lambda x: F.size(F.filter(chars, lambda y: y == x)) / n)
    return F.when(n > 0, -F.aggregate(share, F.lit(0.0), lambda a, p: a + p * F.log2(p))).otherwise(0.0)


def _finding(when: Column, finding_id: str, severity: str, confidence: float, detail: Column | None = None) -> Column:
    detail = F.lit(None).cast("string") if detail is None else detail
    return F.when(when, F.struct(F.lit(finding_id).alias("finding_id"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), detail.cast("string").alias("detail")))


def _hits(text: Column, tokens) -> Column:
    return F.filter(text_literals(sorted(tokens)), lambda t: F.contains(text, t))


def url_findings(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host, url_entropy, findings (array), is_malicious, confidence and n_findings to every row.

    A URL whose address class is not safe gets SSRF_BLOCKED alone; a port that is no number from 0 to 65535 gets
    MALFORMED_URL alone. A null URL is blocked.
    """
    df = risk_class(urls, url_col)
    u = F.trim(F.coalesce(F.col(url_col), F.lit("")))
    df = df.withColumn("_u", F.when(u.rlike(r"^[a-zA-Z][a-zA-Z0-9+\-.]*://"), u).otherwise(F.concat(F.lit("http://"), u)))
    for part in ("host", "path", "query", "fragment", "userinfo", "port"):
        df = df.withColumn(f"_{part}", url_part(F.col("_u"), part))
    df = barrier(df.withColumn("host", F.lower("_host")).drop("_host"))
    host, path, query, url = F.col("host"), F.col("_path"), F.col("_query"), F.col("_u")
    df = df.withColumn("url_entropy", entropy(F.concat(host, path, query)))
    df = df.withColumn("_labels", F.filter(F.split(host, r"\."), lambda x: x != "")).withColumn("_pq", F.lower(F.concat_ws(" ", path, query)))
    df = df.withColumn("_path_hits", _hits(F.col("_pq"), C.PATH_TOKENS)).withColumn("_login_hits", _hits(F.col("_pq"), C.CREDENTIAL_TOKENS))
    labels, hp = F.col("_labels"), F.concat(host, path)
    # the owner's own domain: the brand is a label with at most two labels behind it
    owned = lambda b: F.exists(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: (F.get(labels, i - 1) == b) & (F.size(labels) - i <= 2))
    df = df.withColumn("_brand", F.get(F.filter(text_literals(C.BRAND_TOKENS), lambda b: F.contains(hp, b) & ~F.coalesce(owned(b), F.lit(False))), F.lit(0)))
    df = df.withColumn("_nfkc", nfkc_host(F.when(host.rlike(r"[^\x00-\x7F]"), host)))
    literal = url.rlike(rf"(?i)^https?://\[?{C.IPV4}\]?")
    double = url.rlike(r"%25[0-9a-fA-F]{2}")
    port = F.expr("try_cast(_port AS BIGINT)")
    user, secret = F.split_part(F.col("_userinfo"), F.lit(":"), F.lit(1)), F.split_part(F.col("_userinfo"), F.lit(":"), F.lit(2))
    bad_port = (F.col("_port") != "") & F.coalesce(~F.col("_port").rlike("^[0-9]+$") | (port > 65535), F.lit(True))
    blocked = _finding(F.lit(True), "SSRF_BLOCKED", "CRITICAL", 1.0, F.col("ssrf_risk"))
    malformed = _finding(F.lit(True), "MALFORMED_URL", "MEDIUM", 0.9)
    checks = F.array_compact(F.array(
        _finding(F.element_at(F.split(host, r"\."), -1).isin(*C.SUSPICIOUS_TLDS), "SUSPICIOUS_TLD", "MEDIUM", 0.85, F.concat(F.lit("."), F.element_at(F.split(host, r"\."), -1))),
        _finding(F.size(labels) >= MANY_LABELS, "EXCESSIVE_SUBDOMAIN_DEPTH", "MEDIUM", 0.80),
        _finding(F.col("url_entropy") > HIGH_ENTROPY, "HIGH_URL_ENTROPY", "LOW", 0.75),
        _finding(F.size("_path_hits") > 0, "SUSPICIOUS_PATH_TOKENS", "MEDIUM", 0.82, F.array_join(F.slice("_path_hits", 1, 5), ", ")),
        _finding(F.size("_login_hits") > 0, "CREDENTIAL_HARVESTING_PATH", "HIGH", 0.88, F.array_join(F.slice("_login_hits", 1, 5), ", ")),
        _finding(F.col("_brand").isNotNull(), "BRAND_IMPERSONATION_IN_DOMAIN", "HIGH", 0.90, F.col("_brand")),
        _finding(F.exists(labels, lambda x: x.startswith("xn--")), "PUNYCODE_DOMAIN", "HIGH", 0.92, F.substring(F.get(F.filter(labels, lambda x: x.startswith("xn--")), F.lit(0)), 1, 32)),
        _finding(host.rlike(f"[{C.LOOKALIKE}]"), "UNICODE_HOMOGLYPH", "HIGH", 0.93),
        _finding((F.col("_nfkc") != host) & ~F.col("_nfkc").rlike(r"[^\x00-\x7F]"), "UNICODE_NFKC_NORMALIZATION", "MEDIUM", 0.85),
        _finding(literal, "IP_LITERAL_URL", "HIGH", 0.94),
        _finding(~literal & host.rlike("^(?:0x[0-9a-f]+|0[0-7]+|[0-9]+)$"), "ENCODED_IP_LITERAL", "CRITICAL", 0.97),
        _finding(host.isin(*C.LINK_SHORTENERS), "URL_SHORTENER", "MEDIUM", 0.85, host),
        _finding(double, "DOUBLE_ENCODING", "HIGH", 0.93),
        _finding(~double & (F.regexp_count(url, F.lit("%[0-9a-fA-F]{2}")) > MANY_ESCAPES), "EXCESSIVE_PERCENT_ENCODING", "MEDIUM", 0.80),
        _finding(url.rlike(r"(?i)^https?://[^@\s]+:[^@\s]+@"), "EMBEDDED_CREDENTIALS", "HIGH", 0.96),
        _finding(port.isin(*C.SUSPICIOUS_PORTS), "SUSPICIOUS_PORT", "MEDIUM", 0.82, F.col("_port")),
        _finding(url.rlike(r"(?i)https?://[^\s]*https?://"), "NESTED_URL", "HIGH", 0.92),
        _finding(F.length(url) > LONG_URL, "ABNORMALLY_LONG_URL", "LOW", 0.72),
        _finding(F.col("_fragment").rlike("^https?://"), "REDIRECT_VIA_FRAGMENT", "HIGH", 0.90),
        _finding((user != "") & (secret == ""), "UNUSUAL_USERINFO", "MEDIUM", 0.78),
        _finding(F.regexp_count(url, F.lit("@")) > 1, "MULTIPLE_AT_SIGNS", "HIGH", 0.95),
    ))
    df = df.withColumn("findings", F.when(F.col("ssrf_risk") != "safe", F.array(blocked)).when(bad_port, F.array(malformed)).otherwise(checks))
    serious = F.exists("findings", lambda f: f["severity"].isin("HIGH", "CRITICAL")) | (F.size("findings") >= 3)
    df = df.withColumn("is_malicious", serious).withColumn("n_findings", F.size("findings"))
    top = F.array_max(F.transform("findings", lambda f: f["confidence"]))
    df = df.withColumn("confidence", F.when(F.col("is_malicious"), top).otherwise(0.90))
    return barrier(df.drop("_u", "_path", "_query", "_fragment", "_userinfo", "_port", "_labels", "_pq", "_path_hits", "_login_hits", "_brand", "_nfkc"))


def findings_long(found: DataFrame, url_col: str = "url") -> DataFrame:
    """One row per URL row and finding."""
    return found.select(url_col, F.explode("findings").alias("f")).select(url_col, "f.*")
