"""Indicators of messages: URLs, domains, addresses, phones, e-mails, payment ids, sender ids; address classes; block-lists."""

from __future__ import annotations

import logging
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from smishlake.functions import constants as C
from smishlake.functions.columns import barrier, url_part, with_scheme, words
from smishlake.operators.networks import address, in_network
from smishlake.sources.tables import sized

COLUMNS = ["msg_id", "type", "value", "pos", "confidence", "ssrf_risk", "is_internal", "is_idn", "host"]


def risk_class(df: DataFrame, url_col: str, out: str = "ssrf_risk") -> DataFrame:
    """Adds the static address class of a URL or address: safe, blocked, invalid_scheme, metadata_endpoint, loopback, private_ip."""
    url = F.trim(F.coalesce(F.col(url_col), F.lit("")))
    df = df.withColumn("_u", with_scheme(url)).withColumn("_h", F.lower(url_part(F.col("_u"), "host")))
    df = barrier(df, "_u", "_h")
    scheme, host = F.lower(url_part(F.col("_u"), "scheme")), F.col("_h")
    literal = host.rlike(rf"^(?:{C.IPV4}|.*:.*)$")
    df = barrier(df.withColumn("_a", F.when(literal, address(host))), "_a")
    held = lambda cidrs: reduce(or_, (in_network(F.col("_a"), c) for c in cidrs))
    df = df.withColumn("_p", held(C.PRIVATE_V4)).withColumn("_6", F.when(in_network(F.col("_a"), "::1/128"), "loopback").when(held(C.PRIVATE_V6), "private_ip"))
    risk = (
        F.when(url == "", "blocked")
        .when(~scheme.isin("http", "https"), "invalid_scheme")
        .when(host.isin(*C.METADATA_HOSTS), "metadata_endpoint")
        .when(F.col("_p") & host.startswith("127."), "loopback")
        .when(F.col("_p") & host.startswith("169.254."), "metadata_endpoint")
        .when(F.col("_p"), "private_ip")
        .when(F.col("_6").isNotNull(), F.col("_6"))
        .when(host.isin(*C.LOCAL_HOSTS), "loopback")
        .otherwise("safe")
    )
    return barrier(df.withColumn(out, risk).drop("_u", "_h", "_a", "_p", "_6"), out)


def safe_only(df: DataFrame, risk_col: str = "ssrf_risk") -> DataFrame:
    return df.filter(F.col(risk_col) == "safe")


def strip_punctuation(url: Column) -> Column:
    """Without what running text puts behind a URL."""
    url = F.regexp_replace(url, r"""[.,;:!?"']+$""", "")
    for left, right in (("(", ")"), ("[", "]"), ("{", "}")):
        url = F.when(url.endswith(right) & ~url.contains(left), F.substr(url, F.lit(1), F.length(url) - 1)).otherwise(url)
    return url


def host_of(url: Column) -> Column:
    return F.lower(url_part(with_scheme(url), "host"))


@F.pandas_udf(T.StringType())
def idn_decoded(hosts: pd.Series) -> pd.Series:
    """Hosts with their xn-- labels decoded (Bootstring); a host with a label that does not decode stays as it is."""
    def one(host: str | None) -> str | None:
        try:
            return host and host.encode("ascii").decode("idna")
        except UnicodeError:
            return host

    return hosts.map(one)


def decoded_hosts(df: DataFrame, host_col: str = "host") -> DataFrame:
    """Adds is_idn (a host with an xn-- label or letters beyond ASCII) and host_unicode, its form for readers. Only hosts
    that are flagged go to Python; a null host is not flagged."""
    host = F.col(host_col)
    df = df.withColumn("is_idn", F.coalesce(host.contains("xn--") | host.rlike(r"[^\x00-\x7F]"), F.lit(False)))
    return df.withColumn("host_unicode", F.coalesce(idn_decoded(F.when(F.col("is_idn"), host)), host))


def domain_confidence(host: Column) -> Column:
    return F.when(host.isin(*C.SHORTENERS), 0.97).when(F.element_at(F.split(host, r"\."), -1).isin(*C.RISKY_TLDS) & host.contains("."), 0.92).otherwise(0.88)


def _values(kind: str, values: Column, confidence: float, host: bool = False) -> Column:
    """Structs of the distinct values of a message, in the order of first occurrence."""
    item = lambda v, i: F.struct(F.lit(kind).alias("type"), v.alias("value"), i.alias("pos"), F.lit(confidence).alias("confidence"), (v if host else F.lit(None).cast("string")).alias("host"), F.lit(False).alias("first"))
    return F.transform(F.array_distinct(values), item)


def _all(pattern: str, group: int = 0, needs: str | None = None) -> Column:
    """What the pattern finds; needs is a quick pattern of which every match holds a match: other texts are not searched."""
    none = F.array().cast("array<string>")
    found = F.coalesce(F.regexp_extract_all("raw_text", F.lit(pattern), F.lit(group)), none)
    return F.when(F.col("raw_text").rlike(needs), found).otherwise(none) if needs else found


#: The same URLs as C.URL, without giving back letters of a label that no dot follows; and what each of them holds.
URL = C.URL.replace("{2,63}", "{2,63}+")
URL_NEEDS = rf"(?i)://|www\.|\.(?:{C.URL_TLDS})"


def _urls() -> Column:
    """URLs with their hosts; address literals are left to the addresses. first marks the first URL of a host."""
    found = F.array_distinct(F.transform(_all(f"(?i){URL}", needs=URL_NEEDS), strip_punctuation))
    placed = F.transform(found, lambda v, i: F.struct(v.alias("value"), i.alias("pos"), host_of(v).alias("host")))
    return F.filter(placed, lambda u: (u["host"] != "") & ~u["host"].startswith("[") & ~u["host"].rlike(rf"^{C.IPV4}$"))


#: How the values of each type are found in raw_text, but for URLs and domains.
FINDERS = {
    "ip": lambda: F.concat(_values("ip", _all(words(C.IPV4), needs=r"[0-9]\.[0-9]"), 0.90, True), _values("ip", F.transform(_all(C.IPV6, 1), lambda x: F.concat(F.lit("["), x, F.lit("]"))), 0.90, True)),
    "phone": lambda: _values("phone", F.transform(_all(rf"(?<![0-9]){C.PHONE}(?![0-9])", 1, "[6-9][0-9]{9}"), lambda n: F.concat(F.lit("+91"), n)), 0.93),
    "email": lambda: _values("email", F.transform(_all(words(C.EMAIL), needs="@"), F.lower), 0.95),
    "upi_id": lambda: _values("upi_id", F.transform(_all(f"(?i){words(C.UPI)}", needs="@"), F.lower), 0.97),
    "sender_id": lambda: _values("sender_id", F.transform(_all(f"(?i){words(C.SENDER)}", needs="[a-zA-Z]-[a-zA-Z0-9]{3}"), F.upper), 0.89),
}
KINDS = ("url", "domain", *FINDERS)


def extract_indicators(messages: DataFrame, kinds=KINDS) -> DataFrame:
    """All indicators of all messages(msg_id, raw_text), one row each. Whole texts are searched; a null text has none.

    One scan and one explode: each message's values are gathered in an array, and a URL row that is the first of its host
    in the message also gives the domain row, with its flags. Nothing is shuffled.
    """
    df = messages.select("msg_id", "raw_text")
    arrays = [FINDERS[k]() for k in kinds if k in FINDERS]
    if "url" in kinds or "domain" in kinds:
        df = df.withColumn("_urls", _urls()).withColumn("_hosts", F.transform("_urls", lambda u: u["host"]))
        arrays.append(F.transform("_urls", lambda u, i: F.struct(F.lit("url").alias("type"), u["value"].alias("value"), u["pos"].alias("pos"), domain_confidence(u["host"]).alias("confidence"), u["host"].alias("host"), (F.array_position("_hosts", u["host"]) == i + 1).alias("first"))))
    rows = df.select("msg_id", F.inline(F.concat(*arrays)))
    located = F.col("type").isin("url", "ip")
    rows = risk_class(rows.withColumn("_url", F.when(located, F.col("value"))), "_url").withColumn("ssrf_risk", F.when(located, F.col("ssrf_risk")).otherwise("safe"))
    is_idn = (F.col("type") == "url") & (F.col("host").contains("xn--") | F.col("host").rlike(r"[^\x00-\x7F]"))
    rows = rows.withColumn("is_internal", F.col("ssrf_risk") != "safe").withColumn("is_idn", is_idn)
    given = [F.lit(k) for k in ("url", "domain") if k in kinds]
    if not given:
        return rows.select(*COLUMNS)
    as_domain = F.array(*given) if "domain" in kinds else F.array("type")
    rows = rows.withColumn("kind", F.explode(F.when(F.col("first"), as_domain).when(F.col("type") == "url", F.array(*given[: "url" in kinds])).otherwise(F.array("type"))))
    return rows.withColumn("value", F.when(F.col("kind") == "domain", F.col("host")).otherwise(F.col("value"))).withColumn("type", F.col("kind")).select(*COLUMNS)


def urls(messages: DataFrame) -> DataFrame:
    return extract_indicators(messages, ("url",))


def domains(messages: DataFrame) -> DataFrame:
    """Distinct hosts of the URLs; flags are those of the first URL of a host."""
    return extract_indicators(messages, ("domain",))


def ip_addresses(messages: DataFrame) -> DataFrame:
    return extract_indicators(messages, ("ip",))


def phones(messages: DataFrame) -> DataFrame:
    return extract_indicators(messages, ("phone",))


def emails(messages: DataFrame) -> DataFrame:
    return extract_indicators(messages, ("email",))


def payment_ids(messages: DataFrame) -> DataFrame:
    return extract_indicators(messages, ("upi_id",))


def sender_ids(messages: DataFrame) -> DataFrame:
    return extract_indicators(messages, ("sender_id",))


def threat_report(indicators: DataFrame) -> DataFrame:
    """Counts per message and type, and how many look suspicious."""
    suspicious = F.col("is_internal") | F.col("is_idn") | (F.col("ssrf_risk") != "safe")
    counts = [F.count_if(F.col("type") == t).alias(f"n_{t}") for t in ("url", "domain", "ip", "phone", "email", "upi_id", "sender_id")]
    return indicators.groupBy("msg_id").agg(*counts, F.count_if(suspicious).alias("n_suspicious"))


def blocklist(spark) -> DataFrame:
    """kind, value, category, reputation: a fixed dimension of a few rows."""
    rows = [("domain", v, "phishing_domain", 0.05) for v in C.BLOCKED_DOMAINS] + [("url_host", v, "phishing_url", 0.02) for v in C.BLOCKED_DOMAINS]
    rows += [("url_prefix", v, "phishing_url", 0.02) for v in C.BLOCKED_PREFIXES] + [("upi_id", v, "fraudulent_upi", 0.01) for v in C.BLOCKED_UPI]
    return spark.createDataFrame(rows, T.StructType.fromDDL("kind string, listed string, threat_category string, reputation_score double"))


def enrich(indicators: DataFrame, lists: DataFrame, provider: str = "local") -> DataFrame:
    """msg_id, type, value, provider, threat_category, reputation_score: verdicts of a block-list on listed indicators.

    lists(kind, listed, threat_category, reputation_score) may be of any size: each indicator offers the keys by which it
    may be listed (its value; for a URL its host, and its beginnings of the lengths that the list has), and one equi-join
    meets them. Of several verdicts on an indicator the worst reputation stays, then the first category.
    """
    lengths = sorted(r["n"] for r in lists.filter("kind = 'url_prefix'").select(F.length("listed").alias("n")).distinct().collect())
    value = F.lower("value")
    key = lambda kind, listed: F.struct(kind.alias("kind"), listed.alias("listed"))
    of_url = F.array(key(F.lit("url_host"), F.lower("host")), *(key(F.lit("url_prefix"), F.when(F.length("value") >= n, F.substring(value, 1, n))) for n in lengths))
    keys = F.concat(F.array(key(F.col("type"), value)), F.when(F.col("type") == "url", of_url).otherwise(F.slice(of_url, 1, 0)))
    offered = indicators.select("msg_id", "type", "value", F.explode(keys).alias("k")).select("msg_id", "type", "value", "k.kind", "k.listed")
    hits = offered.join(sized(lists, row_bytes=256), ["kind", "listed"])
    best = hits.groupBy("msg_id", "type", "value").agg(F.min(F.struct("reputation_score", "threat_category")).alias("v"))
    return best.select("msg_id", "type", "value", F.lit(provider).alias("provider"), "v.threat_category", "v.reputation_score")


def enrich_all(indicators: DataFrame, providers: dict) -> DataFrame:
    """Verdicts of several providers, each a block-list or a function that gives one; a provider that fails is skipped."""
    out = None
    for name, provider in providers.items():
        try:
            part = enrich(indicators, provider() if callable(provider) else provider, name)
        except Exception as e:  # whatever a provider raises, the others still answer
            logging.getLogger(__name__).warning("provider %s is skipped: %s", name, e)
            continue
        out = part if out is None else out.unionByName(part)
    if out is None:
        return indicators.sparkSession.createDataFrame([], T.StructType([indicators.schema["msg_id"], *T.StructType.fromDDL("type string, value string, provider string, threat_category string, reputation_score double")]))
    return out


def roll_up(indicators: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """type, value -> number of rows and messages, best confidence and its address class, and how many verdicts there are."""
    out = indicators.groupBy("type", "value").agg(
        F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"), F.max_by("ssrf_risk", F.struct("confidence", "ssrf_risk")).alias("ssrf_risk"), F.count_distinct("msg_id").alias("n_messages"))
    if verdicts is None:
        return out.withColumn("enrichment_count", F.lit(0).cast("long"))
    judged = verdicts.select("type", "value", "provider", "threat_category", "reputation_score").distinct().groupBy("type", "value").agg(F.count(F.lit(1)).alias("enrichment_count"))
    return out.join(judged.hint("merge"), ["type", "value"], "left").fillna(0, ["enrichment_count"])
