"""Operator 6: language identification with error-correcting output codes.

Languages get binary codewords. For each bit a binary n-gram classifier is learned (log ratio of the n-gram rates of the
languages whose bit is one to those whose bit is zero) from n-gram rates that Spark sums per language and bit over all
training rows. A text's bit margins are decoded to the codeword with the least weighted loss; bits that separate the training
languages better weigh more, and a small distance between the two nearest codewords flags the text as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from smishlake.llm.common import map_rows, sized, store, table

BUCKETS = 1 << 15
BITS = 15
#: N-gram rates are summed as whole numbers of this part, so that no order of sums shows.
PART = 10**15
#: A rate that every n-gram has at least.
FLOOR = 1e-7
AMBIGUOUS = 0.2
_SHIFT = np.uint32(17)


def grams(text: str) -> np.ndarray:
    """Hashed 1-, 2- and 3-grams of the letters of a text, with one space for whatever lies between words."""
    p = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = (p >= 97) & (p <= 122) | (p >= 0xAA) & (p != 0xD7) & (p != 0xF7) & ((p < 0x2000) | (p > 0x206F)) & ((p >= 0xC0) | np.isin(p, (0xAA, 0xB5, 0xBA)))
    if not letter.any():
        return np.zeros(0, np.uint32)
    p = np.where(letter, p, np.uint32(32))
    keep = np.ones(len(p), bool)
    keep[1:] = letter[1:] | letter[:-1]
    p = np.concatenate([[np.uint32(32)], p[keep], [np.uint32(32)]]).astype(np.uint32)
    a = p * np.uint32(0x9E3779B1)
    two = (a[:-1] ^ (p[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
    three = (two[:-1] ^ (p[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    return np.concatenate([a, two, three]) >> _SHIFT


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def codewords(n: int, bits: int = BITS) -> np.ndarray:
    """n distinct codewords as rows of 0/1, far apart: all splits for few languages, else the best of seeded draws."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:  # exhaustive code: every split of the languages once
        masks = range(1, 1 << (n - 1))
        return np.array([[(m >> i) & 1 if i < n - 1 else 0 for m in masks] for i in range(n)], np.int8)
    bits = max(bits, 4 * int(np.ceil(np.log2(n))))
    rng, best, far = np.random.default_rng(6), None, -1.0
    for _ in range(max(4, 200 * 64 // max(n, 64))):
        c = rng.integers(0, 2, (n, bits)).astype(np.int8)
        sign = 2.0 * c - 1.0
        least = (bits - np.max(sign @ sign.T - 2 * bits * np.eye(n))) / 2
        split = c.any(0) & ~c.all(0)
        if split.all() and least > far:
            best, far = c, least
    if far < 1:  # drawn alike: the numbers themselves tell them apart
        best = np.array([[(i >> b) & 1 for b in range(n.bit_length())] for i in range(1, n + 1)], np.int8)
    return best


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, 0/1
    weights: np.ndarray  # buckets x bits, float32
    trust: np.ndarray  # weight of each bit in decoding

    def margins(self, text: str) -> np.ndarray | None:
        g = grams(text)
        if not len(g):
            return None
        count = np.bincount(g, minlength=BUCKETS)
        at = np.flatnonzero(count)
        c = count[at].astype(np.float32)
        return (c @ self.weights[at]) / c.sum()

    def decode(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score in 0..1, and whether the two nearest codewords are about as near."""
        if not text or not has_letter(text) or not self.languages:
            return "und", 0.0, True
        m = self.margins(text)
        if m is None:
            return "und", 0.0, True
        sign = 2.0 * self.codes - 1.0
        loss = (self.trust * np.log1p(np.exp(-8.0 * sign * m))).sum(1)
        like = np.exp(-(loss - loss.min()) * 4.0)
        best = int(np.argmin(loss))
        score = float(like[best] / like.sum())
        return self.languages[best], score, bool(len(loss) > 1 and np.partition(loss, 1)[1] - loss[best] < AMBIGUOUS)


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from every row with a text and a language, whatever the number of languages.

    Each task sums its rows' rates per language before the shuffle. Sums per bit and margins per language are taken in
    Spark: what reaches the driver is BUCKETS sums per bit, and one margin per language and bit. Ties between languages go
    to the smaller name.
    """
    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g = grams(text)
                if len(g):  # one text counts once however long it is
                    got = np.bincount(g, minlength=BUCKETS)
                    sums[lang] = sums.get(lang, 0) + got / len(g)
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(np.round(s[at] * 1e9).astype(np.int64))], names=["lang", "bucket", "n"])

    spark = rows.sparkSession
    used = rows.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(text_col, F.col(lang_col).cast("string"))
    counted = used.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counted = store(counted, "language-counts")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    languages = sorted(r["lang"] for r in totals.select("lang").collect())
    codes = codewords(len(languages))
    bits = codes.shape[1]
    weights, trust = np.zeros((BUCKETS, bits), np.float32), np.ones(bits)
    if len(languages) > 1:
        names = spark.createDataFrame([(k, c.tolist()) for k, c in zip(languages, codes, strict=True)], "lang string, code array<int>")
        rates = counted.join(sized(totals, row_bytes=64), "lang").join(sized(names, len(languages), 64 + 4 * bits), "lang")
        rates = store(rates.select("lang", "bucket", "code", F.round(F.col("n").cast("double") / F.col("total") * PART).cast("long").alias("rate")), "language-rates")
        sums = rates.groupBy("bucket").agg(F.sum("rate").alias("all"), *(F.sum(F.col("rate") * F.col("code")[b]).alias(f"b{b}") for b in range(bits))).toPandas().sort_values("bucket")
        every, one = np.zeros(BUCKETS), np.zeros((BUCKETS, bits))
        every[sums["bucket"]] = sums["all"] / PART
        one[sums["bucket"]] = sums[[f"b{b}" for b in range(bits)]].to_numpy(float) / PART
        n_one = codes.sum(0, dtype=int)
        high, low = one / n_one + FLOOR, (every[:, None] - one) / (len(languages) - n_one) + FLOOR
        weights = np.clip(np.log(np.maximum(high, FLOOR) / np.maximum(low, FLOOR)), -6, 6).astype(np.float32)
        held = spark.sparkContext.broadcast(weights)

        def margins(batches):
            sums: dict[str, np.ndarray] = {}
            for batch in batches:
                lang, bucket, rate = batch.column(0).to_pandas(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
                for k, at in lang.groupby(lang).indices.items():
                    sums[k] = sums.get(k, 0) + np.round(held.value[bucket[at]].astype(float) * rate[at, None] / 1e3).astype(np.int64).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([k for k in sums for _ in range(bits)], pa.string()), pa.array(np.tile(np.arange(bits, dtype=np.int32), len(sums))), pa.array(np.concatenate([*sums.values(), np.zeros(0, np.int64)]), pa.int64())], names=["lang", "bit", "m"])

        got = rates.select("lang", "bucket", "rate").mapInArrow(margins, "lang string, bit int, m long").groupBy("lang", "bit").agg(F.sum("m").alias("m")).collect()
        place = {k: i for i, k in enumerate(languages)}
        means = np.zeros((len(languages), bits))  # mean margin of each language's own text
        for r in got:
            means[place[r["lang"]], r["bit"]] = r["m"] * 1e3 / PART
        lowest, highest = np.where(codes == 1, means, np.inf).min(0), np.where(codes == 0, means, -np.inf).max(0)
        weights = weights - ((lowest + highest) / 2).astype(np.float32)
        trust = np.maximum(lowest - highest, 0.05)
    return Model(languages, codes, weights, trust / trust.mean())


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: lang_pred, score, ambiguous. Null texts and texts without a letter give 'und', 0.

    Whole texts are read; repeated rows give repeated rows; other columns are ignored. The model is broadcast: its size
    is BUCKETS times the code length.
    """
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(ids: list, texts: list) -> tuple:
        rows = [shared.value.decode(t) for t in texts]
        return ids, *(list(c) for c in zip(*rows, strict=True))

    return map_rows(df, run, f"{id_col} {kind}, lang_pred string, score double, ambiguous boolean", id_col, text_col)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op6_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out()))
    out = identify(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
