"""Operator 1: toxicity of noisily spelled text.

A character trigram model is counted over all documents. Stretches of a text that look disguised (characters standing in
for letters, letters spaced out, letters drawn out) become lattices of what each character may stand for, and Viterbi
decoding under the model picks the likeliest reading; all other stretches have one reading. The restored text is scored
by words and word beginnings whose toxic share among labelled documents was learned with a beta prior.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from smishlake.llm.common import SLICE_ROWS, map_rows, table

#: Most labelled rows that the scorer learns from; beyond, a sample by hash of doc_id. The model of characters uses all rows.
LABELLED_ROWS = 60_000
#: A feature needs so many toxic documents.
MIN_TOXIC = 6
#: Pseudo-documents of the prior at the overall toxic share.
PRIOR = 4.0
#: A feature counts when most documents that have it are toxic; a beginning, when it gathers more than one word does.
LEAST_SHARE, GATHERS = 0.62, 1.5
PREFIXES = (4, 5, 6, 7, 8)
THRESHOLD = 0.3

# Letters that a character may stand for (fixed values).
STANDS_FOR = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "aeiou"}
SUBSTITUTED, LITERAL, BROKEN, DRAWN_OUT = -0.7, -6.0, -4.0, -0.5
CACHE = 100_000

# ---- character model -------------------------------------------------------------------------------------------------

#: Symbols: 0 is whatever is no letter, 1-26 a-z, then U+00DF-U+00FF, then any other letter.
K = 1 + 26 + 33 + 1


def symbol(c: str) -> int:
    o = ord(c)
    if 97 <= o <= 122:
        return o - 96
    if 0xDF <= o <= 0xFF and o != 0xF7:
        return o - 0xDF + 27
    return K - 1 if c.isalpha() else 0


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    return np.array([symbol(chr(o).lower()[0]) for o in range(0x3000)], np.uint32)


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of symbol trigrams over every row; each task adds up its own before the shuffle, K**3 numbers come back."""
    def count(batches):
        total = np.zeros(K**3, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                text = "\n\n".join(["", *(t or "" for t in batch.column(0).slice(at, 64).to_pylist()), ""])
                p = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                s = np.where(p < 0x3000, symbols()[np.minimum(p, 0x2FFF)], np.uint32(K - 1))
                total += np.bincount((s[:-2] * K + s[1:-1]) * K + s[2:], minlength=K**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

    summed = docs.select(text_col).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(K**3)
    out[summed["gram"].to_numpy(int)] = summed["n"].to_numpy()
    return out


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b) for symbols a, b, c, backed off to bigrams and single symbols."""
    three = counts.reshape(K, K, K)
    two, one = three.sum(0), three.sum((0, 1)) + 1.0
    p1 = one / one.sum()
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    p3 = (three + 5 * p2[None]) / (three.sum(2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


# ---- lattices --------------------------------------------------------------------------------------------------------

_RUN = re.compile(r"(.)\1*", re.S)


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """For each position the readings (letters, perhaps none or a blank) and their channel scores."""
    spaced = len(span) >= 5 and all(not c.isalnum() for c in span[1::2]) and all(len(c) == 1 for c in span[::2])
    out = []
    for i, run in enumerate(_RUN.finditer(span)):
        c, n = run[1], len(run[0])
        stands = STANDS_FOR.get(c, "")
        if c.isalpha():
            if n < 3:
                out.append([(c * n, 0.0)])
            else:
                out.append([(c, DRAWN_OUT), (c * 2, DRAWN_OUT)])
        elif spaced and i:
            out.append([("", 0.0), (" ", BROKEN)] + [(x, SUBSTITUTED) for x in (stands if run.start() % 2 == 0 else "")])
        elif stands and n <= 2:
            out.append([(" ", LITERAL)] + [(x, SUBSTITUTED) for x in stands] + ([(x * 2, SUBSTITUTED) for x in stands] if n == 2 else []))
        elif n <= 2 and c in ".-_·~'":
            out.append([("", LITERAL), (" ", SUBSTITUTED)])
        else:
            out.append([(" ", 0.0)])
    return out


def viterbi(span: str, model: np.ndarray) -> str:
    """The likeliest reading of a span of any length, blanks around it.

    A state is the last two symbols; every state is kept, so the result is exact. Of equal scores the one met first in
    the order of states and readings stays.
    """
    best = {(0, 0): (0.0, None)}
    for choices in [*lattice(span), [(" ", 0.0)]]:
        spelled = [(letters, cost, [symbol(c) for c in letters]) for letters, cost in choices]
        after: dict = {}
        for (a, b), (score, back) in sorted(best.items(), key=lambda kv: kv[0]):
            for letters, cost, marks in spelled:
                x, y, s = a, b, score + cost
                for z in marks:
                    s += float(model[x, y, z])
                    x, y = y, z
                old = after.get((x, y))
                if old is None or s > old[0]:
                    after[x, y] = (s, (back, letters))
        best = after
    _, back = max(best.values(), key=lambda v: v[0])
    out = []
    while back is not None:
        back, letters = back
        out.append(letters)
    return "".join(reversed(out)).strip()


def disguised(text: str) -> list[tuple[int, int]]:
    """Spans of a lower-case text that need a lattice: words in which stand-ins touch letters or a letter comes three
    times in a row, and three or more single characters set apart by one separator each."""
    p = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(p)
    if n < 3:
        return []
    q = np.zeros(n + 8, np.uint32)
    q[4:-4] = p
    small = np.minimum(q, 0x2FFF)
    letter, stand, blank = (symbols()[small] > 0) | (q >= 0x3000), stand_ins()[small], (q == 32) | (q >= 9) & (q <= 13) | (q == 0)
    word = letter | (q >= 48) & (q <= 57)
    triple = np.zeros(n + 8, bool)
    triple[:-2] = (q[:-2] == q[1:-1]) & (q[1:-1] == q[2:])
    run = triple.copy()
    run[1:] |= triple[:-1]
    run[2:] |= triple[:-2]
    near = np.zeros(n + 8, bool)
    near[1:-1] = letter[:-2] | letter[2:]
    odd = (stand & near & ~run) | (run & letter)
    alone = np.zeros(n + 8, bool)
    alone[1:-1] = (letter | stand)[1:-1] & ~word[:-2] & ~word[2:]
    chain = np.zeros(n + 8, bool)
    chain[2:-2] = alone[:-4] & alone[2:-2] & alone[4:] & letter[2:-2]
    chain &= ~(word | blank)[np.r_[1 : n + 8, 0]] | blank[np.r_[1 : n + 8, 0]]
    if not odd.any() and not chain.any():
        return []
    cover = np.zeros(n + 9, bool)
    if odd.any():
        token = np.cumsum(blank)
        hot = np.zeros(int(token[-1]) + 1, bool)
        hot[token[odd]] = True
        cover[:-1] = hot[token] & ~blank
    for k in range(-2, 3):
        cover[:-1] |= np.roll(chain, k)
    edge = np.flatnonzero(cover[1:] != cover[:-1]) + 1
    spans = edge.reshape(-1, 2) - 4
    return [(max(a, 0), min(b, n)) for a, b in spans.tolist()]


@lru_cache(maxsize=1)
def stand_ins() -> np.ndarray:
    out = np.zeros(0x3000, bool)
    out[[ord(c) for c in STANDS_FOR]] = True
    return out


class Restorer:
    def __init__(self, model: np.ndarray):
        self.model, self.cache = model, {}

    def __call__(self, text: str) -> tuple[str, int]:
        """The text in lower case with its disguised spans read anew, and how many they were."""
        text = text.lower()
        spans = disguised(text)
        if not spans:
            return text, 0
        out, at = [], 0
        for a, b in spans:
            out += [text[at:a], self.decode(text[a:b])]
            at = b
        return "".join([*out, text[at:]]), len(spans)

    def decode(self, span: str) -> str:
        if len(set(span)) == 1:  # one letter over and over says nothing
            return span
        got = self.cache.get(span)
        if got is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            got = viterbi(span, self.model)
            if len(span) <= 60:
                self.cache[span] = got
        return got


# ---- scorer ----------------------------------------------------------------------------------------------------------

_WORD = re.compile(r"[^\W\d_]+")


def features(restored: str) -> set[str]:
    """Words of a restored text, and their beginnings marked by a dash."""
    words = set(_WORD.findall(restored))
    out = set(words)
    for k in PREFIXES:
        out.update([w[:k] + "-" for w in words if len(w) > k])
    return out


def smallest_shingle(text: str) -> int:
    """The least hash of the five-word shingles: a copy with few changes keeps it more often than not."""
    words = text.lower().split()
    if len(words) < 5:
        return xxhash.xxh3_64_intdigest(" ".join(words).encode("utf-8", "surrogatepass")) >> 1
    h = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    h = (h + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    n = len(words) - 4
    s = sum((h[j : j + n] ^ np.uint64(j)) * np.uint64(0xC2B2AE3D27D4EB4F + 2 * j) for j in range(5))
    s = (s ^ (s >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return int((s ^ (s >> np.uint64(29))).min() >> np.uint64(1))


def evidence(toxic: int, clean: int, base: float) -> float:
    """Log-likelihood ratio of a feature's own toxic share against the overall one."""
    n = toxic + clean
    terms = ((toxic, base), (clean, 1 - base))
    return 2 * sum(k * np.log(k / (n * b)) for k, b in terms if k)


@dataclass
class Model:
    characters: np.ndarray
    share: dict[str, float] = field(default_factory=dict)
    without: float = 0.0  # toxic share of labelled documents in which no feature stands

    def score(self, restored: str) -> float:
        share = self.share
        return max([self.without, *map(share.__getitem__, features(restored) & share.keys())])


def may_learn(id_col: str = "doc_id") -> Column:
    return ~held_out(id_col)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from documents whose label may be learned; labels(doc_id, toxic) with nulls or repeats are settled by max.

    Counts are of distinct texts: of those that share label and smallest word shingle, as copies do, one counts. With no
    toxic label every score is 0.
    """
    spark = docs.sparkSession
    characters = log_model(trigram_counts(docs))
    known = labels.filter(may_learn() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = known.count()
    if n > LABELLED_ROWS:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * LABELLED_ROWS / n))
    known = F.broadcast(known)  # LABELLED_ROWS rows of 12 bytes at most, give or take the hash
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(known, "doc_id")
    shared = spark.sparkContext.broadcast(characters)

    def counted(rows: DataFrame, wanted) -> DataFrame:
        def count(batches):
            restore, sums, docs = Restorer(shared.value), {}, 0
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    docs += 1
                    found = features(restore(text)[0])
                    for f in found & wanted.value if wanted else found:
                        sums[f] = sums.get(f, 0) + 1
            sums["\0all"] = docs
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array(list(sums.values()), pa.int64())], names=["f", "n"])

        return rows.select("text").mapInArrow(count, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))

    def sketch(ids: list, marks: list, texts: list) -> tuple:
        return ids, marks, [smallest_shingle(t) for t in texts]

    sketched = map_rows(rows, sketch, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, h long", "doc_id", "toxic", "text")
    texts = sketched.groupBy("h", "y").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "y")
    once = docs.select("doc_id", "text").join(F.broadcast(texts), "doc_id")
    toxic = counted(once.filter("y = 1"), None).filter((F.col("n") >= MIN_TOXIC) | (F.col("f") == "\0all"))
    pos = {r["f"]: r["n"] for r in toxic.collect()}  # features of LABELLED_ROWS texts at most
    n_pos = pos.pop("\0all", 0)
    if not n_pos:
        return Model(characters)
    neg = {r["f"]: r["n"] for r in counted(once.filter("y = 0"), spark.sparkContext.broadcast(set(pos))).collect()}
    n_neg = neg.get("\0all", 0)
    base = n_pos / (n_pos + n_neg)
    share = {f: (k + PRIOR * base) / (k + neg.get(f, 0) + PRIOR) for f, k in pos.items()}
    sure = 2 * np.log(len(pos)) + 12  # log-likelihood ratio that a feature must reach, given how many were tried
    keep = {f: s for f, s in share.items() if s >= LEAST_SHARE and evidence(pos[f], neg.get(f, 0), base) >= sure}
    top: dict[str, int] = {}
    for f in keep:
        for k in PREFIXES if f[-1] != "-" else ():
            top[f[:k] + "-"] = max(top.get(f[:k] + "-", 0), pos[f])
    keep = {f: s for f, s in keep.items() if f[-1] != "-" or pos[f] >= GATHERS * top.get(f, 0)}
    return Model(characters, keep, min(base * 0.2, 0.05))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, score 0..1, predicted 0/1, restored (number of stretches that were read anew).

    Null and empty texts get the score of a text without any feature. Whole texts are read; repeated rows give repeated
    rows; other columns are ignored. The model is bounded by the features of LABELLED_ROWS texts and by K**3.
    """
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)
    state: dict = {}

    def run(ids: list, texts: list) -> tuple:
        restore = state.get("r") or state.setdefault("r", Restorer(shared.value.characters))
        scores, spans = [], []
        for t in texts:
            text, n = restore(t or "")
            scores.append(shared.value.score(text))
            spans.append(n)
        return ids, scores, [int(s >= THRESHOLD) for s in scores], spans

    return map_rows(df, run, f"{id_col} {kind}, score double, predicted int, restored bigint", id_col, text_col)


def filter_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with all their columns and without a shuffle; null texts stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        restore = Restorer(shared.value.characters)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                yield batch.filter(pa.array([not t or shared.value.score(restore(t)[0]) < THRESHOLD for t in texts]))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted", "restored")
