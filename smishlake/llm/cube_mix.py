"""Operator 8: mixing sources to target weights by the cube method.

A source's rate (target over size) splits into whole copies that every document gets and a fractional inclusion
probability. The flight phase moves the fractional probabilities of three documents at a time along the null space of two
constraints, words and number of documents, until one of them is 0 or 1; both totals stay as they were. Blocks of a
source fly side by side in Spark and leave at most two fractional documents each; these fly again, block by block,
until one block is left per source; the last flight leaves LANDING + 2 documents at most, and the landing tries all ways
to settle those and takes the one nearest to the target.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from smishlake.llm.common import sized, store, table, unused

WEIGHTS = (5, 2, 1)
SHARE, MOST_COPIES = 1.5, 2.0
#: Documents of a source that one flight takes.
BLOCK = 4096
#: Documents of a source that stay out of its last flight, for the landing to choose among.
LANDING = 12
EPS = 1e-9


def words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> target: SHARE of all words dealt by weight, no source above MOST_COPIES times its size.

    Sources by code point, null last, weigh WEIGHTS in turn. What a full source cannot take goes to the others by weight,
    so the level rises until none is above: sources in order of capacity per weight fill up one after the other. The
    table has one row per source, which is what the two windows see.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(w) - 1
    s = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(float(x)) for x in WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int")))
    s = s.withColumn("cap", MOST_COPIES * F.col("source_size")).withColumn("need", F.col("cap") / F.col("weight"))
    order = Window.orderBy("need", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", SHARE * F.sum("source_size").over(every)).withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.col("left"))
    # the level at the first source that it does not fill holds for all after it
    first = F.min(F.when(F.col("level") <= F.col("need"), F.struct(F.col("place"), F.col("level")))).over(every)
    s = s.withColumn("place", F.row_number().over(order)).withColumn("final", first["level"])
    return s.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("final"), F.lit(float("inf"))) * F.col("weight")).alias("target"))


def fly(pi: np.ndarray, x: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Flight over documents in their order, with constraints sum(pi) and sum(pi * x); at most two stay fractional."""
    pi, x = pi.tolist(), x.tolist()
    u = u.tolist()
    live: list[int] = []
    step = 0
    for k in range(len(pi)):
        if not EPS < pi[k] < 1 - EPS:
            pi[k] = float(round(pi[k]))
            continue
        live.append(k)
        while len(live) == 3:
            a, b, c = live
            v = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
            if v == (0, 0, 0):
                v = (1.0, -1.0, 0.0)
            up = min(((1 - pi[i]) / d if d > 0 else -pi[i] / d) for i, d in zip(live, v, strict=True) if d)
            down = min((pi[i] / d if d > 0 else (pi[i] - 1) / d) for i, d in zip(live, v, strict=True) if d)
            t = up if u[step % len(u)] * (up + down) < down else -down
            step += 1
            for i, d in zip(live, v, strict=True):
                pi[i] += t * d
                if pi[i] < EPS or pi[i] > 1 - EPS:
                    pi[i] = float(round(pi[i]))
            live = [i for i in live if 0 < pi[i] < 1]
    return np.array(pi)


def land(pi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Settle the few that are left: of all ways, the one whose words come nearest, then whose count does."""
    at = np.flatnonzero((pi > 0) & (pi < 1))
    if len(at):
        ways = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
        off = np.abs(ways @ x[at] - (pi[at] * x[at]).sum()) / max(x[at].mean(), 1.0) + 0.02 * np.abs(ways.sum(1) - pi[at].sum())
        pi[at] = ways[int(np.argmin(off))]
    return pi


def _flight(last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "doc_key"], kind="stable")
        u = ((rows["order"].to_numpy(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) / float(1 << 53)
        pi, size = rows["pi"].to_numpy(float, copy=True), rows["size"].to_numpy(float)
        away = max(0, len(rows) - LANDING) if last else len(rows)
        pi[:away] = fly(pi[:away], size[:away], u)
        return rows.assign(pi=land(pi, size) if last else pi)

    return run


def inclusion(rows: DataFrame) -> DataFrame:
    """rows(doc_key, stratum, size, pi) -> doc_key, taken 0/1, by flights over blocks of each stratum.

    Each flight sees at most about BLOCK rows, so a stratum with a third of all rows is many blocks. Results follow from
    doc_key alone, whatever the partitioning.
    """
    schema = "doc_key string, stratum long, size long, pi double, order long, block long"
    counts = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    counts = store(counts, "cube-strata")
    most = counts.agg(F.max("n")).first()[0] or 0
    rows = rows.withColumn("order", F.xxhash64("doc_key")).join(sized(counts), "stratum")
    blocks = F.ceil(F.col("n") / BLOCK)
    rows = rows.withColumn("block", F.pmod("order", blocks)).select("doc_key", "stratum", "size", "pi", "order", "block")
    n_blocks, settled = -(-most // BLOCK), []
    while True:
        last = n_blocks <= 1
        flown = store(rows.groupBy("stratum", "block").applyInPandas(_flight(last), schema), "cube-flight")
        settled.append(flown.filter("pi IN (0, 1)").select("doc_key", F.col("pi").cast("int").alias("taken")))
        if last:
            break
        n_blocks = -(-n_blocks * 2 // BLOCK)
        rows = flown.filter("pi NOT IN (0, 1)").withColumn("block", F.pmod(F.col("block"), F.lit(n_blocks)))
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id_col, source, size, source_size, target, copies and taken (copies times size) for every row.

    Texts without words and null texts have size 0 and no copy. A null source is a source. Repeated rows are documents of
    their own: rows of one id are told apart by number and share nothing but their id. Other columns are ignored.
    """
    return _dealt(df, id_col, text_col, source_col).drop("k")


def _dealt(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The rows of mix(), with k: the number of a row among those of its id, source and size, from 1."""
    docs = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"))
    docs = store(docs, "mix-sizes")
    sizes = store(targets(docs.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    strata = sizes.withColumn("stratum", F.xxhash64("source")).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    strata = strata.withColumnRenamed("source", "_source")
    rows = docs.join(sized(strata), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    rows = rows.withColumn("whole", F.floor(F.col("rate") + EPS)).withColumn("pi", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    # rows that share an id, source and size are alike; one row stands for them with their number
    alike = rows.groupBy("id", "source", "size", "source_size", "target", "stratum", "whole", "pi").agg(F.count(F.lit(1)).alias("n"))
    alike = alike.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    alike = alike.withColumn("doc_key", F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("null")), "size", "stratum", "k"))
    alike = store(alike, "mix-rows")
    drawn = inclusion(alike.filter((F.col("size") > 0) & (F.col("pi") > EPS)).select("doc_key", "stratum", "size", "pi"))
    out = alike.join(drawn.hint("merge"), "doc_key", "left")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("taken", F.lit(0))).otherwise(0).cast("int")
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), "k")


def op8_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def repeat_rows(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it was taken, with their own columns of any names.

    Every row has its own copies, also where rows repeat a doc_id or have none: rows of one doc_id, source and size take
    the copies of that many rows of the mix in the order of a hash of their columns. Null and empty texts are not taken.
    """
    # the key is never null; window and join share it, so texts are shuffled once
    key_of = lambda size: F.concat_ws("|", F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("null")), size, F.xxhash64("source"))
    key, place, taken = (unused(x, docs) for x in ("key", "place", "taken"))
    copies = _dealt(docs, "doc_id", "text", "source").filter("size > 0").select(key_of(F.col("size")).alias(key), F.struct("k", "copies").alias("c"))
    copies = copies.groupBy(key).agg(F.array_sort(F.collect_list("c")).alias(taken)).filter(F.exists(taken, lambda c: c["copies"] > 0))
    rows = docs.withColumn(key, key_of(words(F.col("text"))))
    rows = rows.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))))
    own = rows.join(copies.hint("merge"), key).withColumn(taken, F.element_at(taken, F.col(place))["copies"]).filter(F.col(taken) > 0)
    return own.withColumn(place, F.explode(F.sequence(F.lit(1), F.col(taken)))).select(*(F.col(f"`{c}`") for c in docs.columns))
