"""Operator 4: quality rules whose failures are judged per host.

Each document is measured once. Its rule failures are summed per host, every host's failure rate is shrunk towards the
corpus by a beta prior fitted to the hosts themselves (method of moments), and a host is known for a rule when its rate is
likely well above that of the corpus. The verdicts are joined back: a document that breaks a rule goes when its host is known
for breaking that rule, so clean documents of a bad host stay, and so does a lone slip on a host that seldom slips.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from smishlake.llm.common import map_rows, sized, store, table, unused

WINDOW = 8
#: A host is known for a rule when its rate is LIFT times that of the corpus or more with nine chances in ten: its shrunk rate
#: lies SURE posterior deviations above that. So more documents make a verdict surer, but not a host of slightly more failures
#: known.
SURE, LIFT = 1.2816, 1.5
#: Most pseudo-documents that the prior may weigh, so that a host of some hundred documents speaks for itself.
PRIOR_WEIGHT = 100.0
_WHITE = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"
_MIX = np.random.default_rng(8).integers(0, 1 << 63, WINDOW, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def repeated_words(words: list) -> int:
    """Words inside windows of eight that occur twice or more."""
    if len(words) <= WINDOW:
        return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, len(words)) + np.uint64(1)
    ids *= np.uint64(0x9E3779B97F4A7C15)
    ids ^= ids >> np.uint64(29)
    n = len(ids) - WINDOW + 1
    h = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        h += ids[j : j + n] * _MIX[j]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    np.subtract.at(edge, at + WINDOW, 1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measures(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, _WHITE))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_WHITE)]
    return len(words), chars, symbols, len(lines), len(lines) - len(set(lines)), repeated_words(words)


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """id_col, host and the measures of each whole text (null: no words). Repeated rows give repeated rows."""
    def run(ids: list, hosts: list, texts: list) -> tuple:
        rows = [measures(t or "") for t in texts]
        return ids, hosts, *(list(c) for c in zip(*rows, strict=True))

    kind, host = df.schema[id_col].dataType.simpleString(), df.schema[host_col].dataType.simpleString()
    schema = f"{id_col} {kind}, host {host}, n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint"
    return map_rows(df, run, schema, id_col, host_col, text_col)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """The rules that are judged per host; each is a ratio of whole-text measures."""
    n = F.col("n_words")
    return {
        "symbols": 10 * F.col("n_symbols") > n,
        "word_length": (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 12 * n),
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "repeats": 100 * F.col("n_repeat_words") > 15 * n,
    }


def host_rates(measured: DataFrame) -> DataFrame:
    """One row per host: n_docs, and for each rule its shrunk failure rate rate_RULE and known_RULE, the verdict.

    Prior of a rule: its mean m is the corpus rate. The hosts' rates scatter more than documents drawn at that rate would;
    the intra-host correlation rho that explains the excess, by moments, gives 1 / rho - 1 pseudo-documents, kept between
    1 and PRIOR_WEIGHT (which holds where there is no excess, or one host). A null host is a host.
    """
    names = list(rules())
    per_host = store(measured.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *(F.sum(c.cast("long")).alias(f"n_{k}") for k, c in rules().items())), "host-counts")
    n = F.col("n_docs")
    row = per_host.agg(F.count(F.lit(1)).alias("hosts"), F.sum("n_docs").alias("docs"), F.sum(n * n.cast("double")).alias("nn"), *(F.sum(f"n_{k}").alias(f"m_{k}") for k in names), *(F.sum(F.col(f"n_{k}") * F.col(f"n_{k}") / n).alias(f"q_{k}") for k in names)).first()
    docs, hosts = float(row["docs"] or 0), row["hosts"]
    free = docs - row["nn"] / docs - (hosts - 1) if docs else 0.0
    out = []
    for k in names:
        m = row[f"m_{k}"] / docs if docs else 0.0
        spread = m * (1 - m)
        rho = ((row[f"q_{k}"] - docs * m * m) / spread - (hosts - 1)) / free if spread > 0 and free > 0 else 0.0
        weight = min(max(1 / rho - 1, 1.0), PRIOR_WEIGHT) if rho > 0 else PRIOR_WEIGHT
        rate = (F.col(f"n_{k}") + F.lit(m * weight)) / (n + F.lit(weight))
        known = (rate - LIFT * m > 0) & (rate - LIFT * m > SURE * F.sqrt(rate * (1 - rate) / (n + F.lit(weight + 1))))
        out += [rate.alias(f"rate_{k}"), known.alias(f"known_{k}")]
    return per_host.select("host", "n_docs", *out)


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Measures, base_failed, failed_rules, host_rules (rules its host is known for) and kept for every row.

    Null text or host, empty texts, repeated rows and empty tables are allowed: a text without words fails the base, a
    null host counts as one host. Columns besides the three named are ignored.
    """
    measured = store(measure(df, id_col, text_col, host_col), "host-rules")
    rates = store(host_rates(measured), "host-rates")
    verdict = rates.select(F.col("host").alias("_host"), F.array_compact(F.array(*(F.when(F.col(f"known_{k}"), F.lit(k)) for k in rules()))).alias("host_rules"))
    failed = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules().items())))
    return (
        measured.withColumn("base_failed", base_failed())
        .withColumn("failed_rules", failed)
        .join(sized(verdict, row_bytes=256), F.col("host").eqNullSafe(F.col("_host")), "left")
        .withColumn("kept", ~F.col("base_failed") & ~F.arrays_overlap("failed_rules", "host_rules"))
        .drop("_host")
    )


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def filter_kept(df: DataFrame) -> DataFrame:
    """The rows that the rules keep, with their own columns of any names.

    Every row is judged by itself, also where rows repeat a doc_id or have none; null and empty texts go.
    """
    name = unused("key", df)
    keyed = df.withColumn(name, F.concat_ws("|", F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("null")), F.xxhash64("text"), F.xxhash64("source")))
    gone = store(judge(keyed, name).filter("NOT kept").select(name).distinct(), "rejected-documents")
    return keyed.join(sized(gone), name, "left_anti").drop(name)


ORACLE = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS pos FROM d),
wc AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
lc AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, pos, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o, lead(word, 5) OVER o, lead(word, 6) OVER o, lead(word, 7) OVER o) AS gram, lead(word, 7) OVER o AS last FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
t AS (SELECT doc_id, gram FROM g WHERE last IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
h AS (SELECT g.doc_id, g.pos FROM g JOIN t USING (doc_id, gram) WHERE last IS NOT NULL),
rc AS (SELECT doc_id, count(DISTINCT pos + k) AS n_repeat_words FROM h, range(8) r(k) GROUP BY doc_id),
m AS (SELECT d.doc_id, host, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN wc USING (doc_id) LEFT JOIN lc USING (doc_id) LEFT JOIN rc USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, unnest([
  {'rule': 'symbols', 'failed': 10 * n_symbols > n_words}, {'rule': 'word_length', 'failed': word_chars < 3 * n_words OR word_chars > 12 * n_words},
  {'rule': 'dup_lines', 'failed': 10 * n_dup_lines > 3 * n_lines}, {'rule': 'repeats', 'failed': 100 * n_repeat_words > 15 * n_words}]) AS r FROM m),
hr AS (SELECT host, r.rule AS rule, count(*) AS n, count(*) FILTER (r.failed) AS bad FROM f GROUP BY ALL),
pr AS (SELECT rule, count(*) AS hosts, sum(n) AS docs, sum(bad) / sum(n) AS mean, sum(bad * bad / n) - sum(n) * (sum(bad) / sum(n)) ** 2 AS sq, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS free FROM hr GROUP BY rule),
po AS (SELECT rule, mean, CASE WHEN mean > 0 AND mean < 1 AND free > 0 THEN (sq / (mean * (1 - mean)) - (hosts - 1)) / free ELSE 0 END AS rho FROM pr),
pw AS (SELECT rule, mean, CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 1), 100) ELSE 100 END AS weight FROM po),
sh AS (SELECT host, rule, mean, n + weight + 1 AS seen, (bad + mean * weight) / (n + weight) AS rate FROM hr JOIN pw USING (rule)),
v AS (SELECT host, rule, rate - 1.5::DOUBLE * mean > 0 AND rate - 1.5::DOUBLE * mean > 1.2816::DOUBLE * sqrt(rate * (1 - rate) / seen) AS known FROM sh)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bool_or(r.failed AND known) AS kept
FROM f JOIN v ON f.r.rule = v.rule AND f.host IS NOT DISTINCT FROM v.host GROUP BY doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed
"""
