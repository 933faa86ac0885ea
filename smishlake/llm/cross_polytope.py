"""Operator 3: embedding near-duplicates by cross-polytope hashing.

Vectors with the same components are one vector with a weight. A hash of a vector is the largest coordinate, with its
sign, after three rounds of random signs and a fast Hadamard transform; two hashes make a bucket of one table, and each
vector also goes to the buckets of its next best coordinates (multiprobe). Buckets of any size are verified in blocks, on
unit vectors in single precision; a pair is counted in the first bucket that it shares. What leaves a task is one row per
vector (how many it links to, and the component there) and the few pairs too near the threshold for single precision,
which are settled in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from smishlake.llm.common import map_rows, store, table, whole_groups
from smishlake.llm.graphs import components

THRESHOLD = 0.93
HASHES, TABLES, PROBES = 2, 8, 4
#: Vectors in a block; a larger bucket is compared block by block.
BLOCK = 1024
#: Buckets up to this size are compared many at once, pair by pair; pairs at once.
SMALL, CHUNK = 48, 1 << 16
#: Cosines of single-precision vectors this near the threshold, times the dimension, are taken again in double precision.
MARGIN = 2e-7


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def codes(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """rows x (tables * probes) bucket codes; equal codes mean the same bucket of the same table."""
    n, dim = x.shape
    d = 1 << max(3, (dim - 1).bit_length())  # room for the probes
    padded = np.zeros((n, d))
    padded[:, :dim] = x
    rng = np.random.default_rng(dim)
    out = np.empty((n, tables, probes), np.int64)
    row = np.arange(n)
    for t in range(tables):
        best = np.zeros(n, np.int64)
        swaps = []
        for k in range(hashes):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            size = np.abs(y)
            order = np.argsort(-size, axis=1, kind="stable")[:, : max(2, probes)]
            code = order * 2 + (np.take_along_axis(y, order, 1) < 0)
            scale = (2 * d) ** k
            best += code[:, 0] * scale
            for j in range(1, order.shape[1]):  # cost of taking the next best coordinate instead
                swaps.append((size[row, order[:, 0]] - size[row, order[:, j]], (code[:, j] - code[:, 0]) * scale))
        cost = np.stack([s[0] for s in swaps], 1)
        change = np.stack([s[1] for s in swaps], 1)
        cheap = np.argsort(cost, axis=1, kind="stable")[:, : probes - 1]
        out[:, t, 0] = best
        out[:, t, 1:] = best[:, None] + np.take_along_axis(change, cheap, 1)
        out[:, t] += t * (2 * d) ** hashes
    return out.reshape(n, -1)


def _near(unit: np.ndarray, edge: np.ndarray, apart: np.ndarray, mine: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine) of the pairs of rows of one bucket with a cosine of at least `least`.

    edge marks where buckets begin; in a bucket that is apart only rows of its two blocks meet.
    """
    starts = np.flatnonzero(edge)
    sizes = np.diff(np.r_[starts, len(edge)])
    out = []

    def take(i: np.ndarray, j: np.ndarray, c: np.ndarray) -> None:
        fine = (c >= least) & (~apart[i] | (mine[i] != mine[j]))
        out.append((i[fine], j[fine], c[fine]))

    for a, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        product = unit[a : a + n] @ unit[a : a + n].T
        i, j = np.nonzero(np.triu(product >= least, 1))
        take(i + a, j + a, product[i, j])
    behind = np.repeat(starts + sizes, sizes) - np.arange(len(edge)) - 1
    behind[np.repeat(sizes > SMALL, sizes)] = 0
    done, total = 0, np.cumsum(behind)
    while done < len(edge):
        to = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + CHUNK, "right")))
        c = behind[done:to]
        i = np.repeat(np.arange(done, to), c)
        j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + i + 1
        if len(i):
            take(i, j, np.einsum("ij,ij->i", unit[i], unit[j]))
        done = to
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _first_shared(unit: np.ndarray, bucket: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs have the bucket that they met in as the least one that they share."""
    rows, back = np.unique(np.concatenate([i, j]), return_inverse=True)
    code = codes(unit[rows].astype(float)) if len(rows) else np.zeros((0, 1), np.int64)
    first = np.empty(len(i), bool)
    for a in range(0, len(i), 20_000):
        x, y = code[back[a : min(a + 20_000, len(i))]], code[back[len(i) + a : len(i) + min(a + 20_000, len(i))]]
        both = (x[:, :, None] == y[:, None, :]).any(2)
        first[a : a + 20_000] = np.where(both, x, np.iinfo(np.int64).max).min(1) == bucket[i[a : a + 20_000]]
    return first


def _summed(ids: np.ndarray, weights: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, links, least id that it connects to) of the vectors in links i, j."""
    nodes, back = np.unique(np.concatenate([ids[i], ids[j]]), return_inverse=True)
    a, b = back[: len(i)], back[len(i) :]
    count = np.zeros(len(nodes), np.int64)
    np.add.at(count, a, weights[j])
    np.add.at(count, b, weights[i])
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        if (before == label).all():
            return nodes, count, nodes[label]


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", threshold: float = THRESHOLD) -> DataFrame:
    """id_col, n_links, component_id, kept for every row; rows link when labels are equal and cosine >= threshold.

    A vector that is null, zero, or holds a null or non-finite component links with nothing, nor does one whose label is
    null; both are kept. Vectors of different lengths do not link. Repeated rows are vectors of their own. Other columns
    are ignored.
    """
    v, x = F.col("v"), F.transform(F.col(vec_col), lambda c: c.cast("double"))
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    rows = df.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), x.alias("v"))
    fine = v.isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda c: c != 0), F.lit(False))
    keyed = rows.select("id", "label", F.when(fine, v).alias("v"))
    plus_zero = F.transform("v", lambda c: c + F.lit(0.0))  # -0.0 is 0.0
    keyed = store(keyed.select("id", "label", "v", F.xxhash64("label", plus_zero).alias("k1"), F.xxhash64(F.lit(7), plus_zero, "label").alias("k2")), "cp-rows")
    good = keyed.filter("v IS NOT NULL")
    same = good.groupBy("label", "k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    same = store(same, "cp-distinct")
    reps = good.select(F.col("id").alias("rep"), "label", "k1", "k2", "v").join(same.hint("merge"), ["rep", "label", "k1", "k2"]).dropDuplicates(["rep"])

    def hashed(ids: list, labels: list, weights: list, vectors: pa.Array) -> tuple:
        out, unit, single = [None] * len(ids), [None] * len(ids), [None] * len(ids)
        lengths = np.diff(vectors.offsets.to_numpy())
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        for dim in set(lengths.tolist()):
            at = np.flatnonzero(lengths == dim)
            m = np.stack([flat[ends[i] - dim : ends[i]] for i in at])
            m = m / np.abs(m).max(1, keepdims=True)
            m = m / np.linalg.norm(m, axis=1, keepdims=True)
            for i, c, u, s in zip(at, codes(m.astype(np.float32).astype(float)), m, m.astype(np.float32), strict=True):
                out[i], unit[i], single[i] = c, u, s
        return ids, labels, weights, out, unit, single

    reps = map_rows(reps, hashed, "rep long, label string, weight long, codes array<long>, unit array<double>, single array<float>", "rep", "label", "weight", "v")
    reps = store(reps, "cp-codes")
    placed = reps.select("rep", "label", F.size("unit").alias("dim"), F.explode(F.array_distinct("codes")).alias("bucket"))
    sizes = store(placed.groupBy("label", "dim", "bucket").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "cp-buckets")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    placed = placed.join(sizes.hint("merge"), ["label", "dim", "bucket"]).withColumn("blocks", blocks)
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("rep", "label", "dim", "bucket", F.least("mine", "theirs").alias("one"), F.greatest("mine", "theirs").alias("two"), "mine")
    full = placed.join(reps.select("rep", "weight", "single").hint("merge"), "rep")
    key = ["label", "dim", "bucket", "one", "two"]
    tasks = full.repartition(*key).sortWithinPartitions(*key)

    def links_of(rows: pa.Table, dim: int):
        col = lambda c: rows[c].to_numpy(zero_copy_only=False)
        ids, weights, bucket, one, two, mine = map(col, ("rep", "weight", "bucket", "one", "two", "mine"))
        label = rows["label"].combine_chunks().dictionary_encode().indices.to_numpy()
        unit = rows["single"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        edge = np.r_[True, np.any([c[1:] != c[:-1] for c in (label, bucket, one, two)], axis=0)]
        i, j, cosine = _near(unit, edge, one != two, mine, threshold - MARGIN * dim)
        fine = _first_shared(unit, bucket, i, j)
        i, j, cosine = i[fine], j[fine], cosine[fine]
        sure = cosine >= threshold + MARGIN * dim
        ids_, links, component = _summed(ids, weights, i[sure], j[sure])
        i, j = i[~sure], j[~sure]
        links = pa.array(np.r_[links, np.zeros(len(i), np.int64)], mask=np.r_[np.zeros(len(links), bool), np.ones(len(i), bool)])
        return pa.RecordBatch.from_arrays([pa.array(np.r_[ids_, ids[i]]), links, pa.array(np.r_[component, ids[j]])], names=["rep", "links", "component"])

    def verify(batches):
        for rows in whole_groups(batches, key):
            dims = rows["dim"].to_numpy()
            for dim in np.unique(dims):
                yield links_of(rows.filter(pa.array(dims == dim)), int(dim))

    links = store(tasks.mapInArrow(verify, "rep long, links long, component long"), "cp-links")
    exact = reps.select("rep", "weight", "unit")
    doubt = links.filter("links IS NULL").select(F.col("rep").alias("a"), F.col("component").alias("b"))
    doubt = doubt.join(exact.select(F.col("rep").alias("a"), F.col("weight").alias("wa"), F.col("unit").alias("x")).hint("merge"), "a").join(exact.select(F.col("rep").alias("b"), F.col("weight").alias("wb"), F.col("unit").alias("y")).hint("merge"), "b")
    cosine = F.aggregate(F.zip_with("x", "y", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    doubt = store(doubt.filter(cosine >= threshold).select("a", "b", "wa", "wb"), "cp-doubt")
    settled = doubt.select(F.col("a").alias("rep"), F.col("wb").alias("links"), F.col("b").alias("component")).unionByName(doubt.select(F.col("b").alias("rep"), F.col("wa").alias("links"), F.col("b").alias("component")))
    links = links.filter("links IS NOT NULL").unionByName(settled)
    counted = links.groupBy("rep").agg(F.sum("links").alias("links"))
    found = components(links.select(F.col("rep").alias("a"), F.col("component").alias("b")))
    per_rep = same.join(counted.hint("merge"), "rep", "left").join(found.select(F.col("node").alias("rep"), "component").hint("merge"), "rep", "left")
    per_rep = per_rep.select("label", "k1", "k2", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    per_rep = store(per_rep, "cp-groups")
    linked = good.select("id", "label", "k1", "k2").join(per_rep.hint("merge"), ["label", "k1", "k2"]).select("id", "n_links", "component_id")
    alone = keyed.filter("v IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op3_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (WITH RECURSIVE c(node, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT c.node, p.b FROM c JOIN p ON p.a = c.reach) SELECT node, min(reach) AS component_id FROM c GROUP BY node)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN r ON r.node = vec_id LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY a) ON a = vec_id
"""
