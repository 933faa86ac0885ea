"""Operator 13: vector codes by product quantisation, with Lloyd rounds over resident members.

A vector is cut into parts; each part position has a codebook of entries. Members (one row per vector and position) are
dealt once by (position, entry, salt) and stay where they lie. A round sums the members of every entry where they are
(partial sums, so an entry with any number of members is spread over its salts), replaces the entries, and looks in place
at which members have become nearer to another entry: only these rows go through the next shuffle, as arrivals of their new
owner. The members of a round are the rows of all earlier deals whose entry is still their nearest one in every codebook
since; that is worked out again where the rows lie, which costs less than writing them again.

All arithmetic is on integers. Codebooks are the only thing that the driver holds: entries * length of a vector numbers.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from smishlake.llm.common import map_rows, sized, store, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Members of an owner, were all members of a position in one entry; more are dealt over salts.
OWNED = 4096
#: Components are kept within this bound, so that squared distances fit 64 bits.
MOST = 1 << 26
#: Distances worked out at once, members looked at at once.
AT_ONCE, SLICE = 1 << 20, 8192
MEMBER = "row long, pos int, entry int, salt int, part array<int>"


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (lower index on ties) and squared distance, for each row of x."""
    index, distance = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
    step = max(1, AT_ONCE // max(1, len(book)))
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    exact = np.float64 if 4 * top * top * max(1, x.shape[1]) < 1 << 53 else np.int64  # products of floats are exact up to there
    c = book.astype(exact)
    cc = (c * c).sum(1)
    for a in range(0, len(x), step):
        y = x[a : a + step].astype(exact)
        d = cc[None] - 2 * (y @ c.T)
        index[a : a + step] = d.argmin(1)
        distance[a : a + step] = (d.min(1) + (y * y).sum(1)).astype(np.int64)
    return index, distance


def _by_position(pos: np.ndarray, x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """nearest() of rows of several positions; books[pos] is the codebook of a position."""
    index, distance = np.zeros(len(pos), np.int32), np.zeros(len(pos), np.int64)
    for p in np.unique(pos):
        at = np.flatnonzero(pos == p)
        index[at], distance[at] = nearest(x[at], books[p])
    return index, distance


def _usable(v: Column) -> Column:
    return v.isNotNull() & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def _salted(rows: np.ndarray, salts: int) -> np.ndarray:
    mixed = (rows.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(salts)).astype(np.int32)


def _lists(x: np.ndarray, kind) -> pa.Array:
    """Rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), pa.array(x.ravel().astype(kind)))


class Lloyd:
    """Members, dealt by owner, and the codebooks of every round so far; books[r] has position, entry, component.

    deals[r] holds the members that came to their owner under books[r]; `settled` is the last codebook under which members
    have moved.
    """

    def __init__(self, rows: DataFrame, start: np.ndarray, parts: int, count: int):
        self.books, self.parts, self.settled = [start], parts, 0
        self.salts = max(1, -(-count // OWNED))
        self.width = start.shape[2]
        self.deals: list[DataFrame] = [self._dealt(self._first(rows), "first")]

    def _dealt(self, members: DataFrame, name: str) -> DataFrame:
        """The members at their owners: one shuffle by (position, entry, salt), written there."""
        owner = ["pos", "entry", "salt"]
        return store(members.repartition(*owner).sortWithinPartitions(*owner), f"lloyd-{name}")

    def _first(self, rows: DataFrame) -> DataFrame:
        book, parts, width, salts = self.books[0], self.parts, self.width, self.salts

        def run(row: list, vectors: pa.Array) -> tuple:
            x, row = _matrix(vectors, parts * width), np.asarray(row, np.int64)
            entries = np.stack([nearest(x[:, p * width : (p + 1) * width], book[p])[0] for p in range(parts)], 1)
            return np.repeat(row, parts), np.tile(np.arange(parts, dtype=np.int32), len(row)), entries.ravel(), np.repeat(_salted(row, salts), parts), _lists(x.reshape(len(row) * parts, width), np.int32)

        return map_rows(rows, run, MEMBER, "row", "v")

    def _members(self, then, schema: str) -> DataFrame:
        """Runs then(row, pos, entry, x) on the members where they lie: of each deal the rows that have not moved since."""
        out, width = None, self.width
        for deal, rows in enumerate(self.deals):
            since = self.books[deal + 1 : self.settled + 1]

            def run(row: list, pos: list, entry: list, part: pa.Array, since=since) -> tuple:
                row, pos, entry = np.asarray(row, np.int64), np.asarray(pos, np.int32), np.asarray(entry, np.int32)
                x = _matrix(part, width)
                for book in since:
                    stays = _by_position(pos, x, book)[0] == entry
                    row, pos, entry, x = row[stays], pos[stays], entry[stays], x[stays]
                return then(row, pos, entry, x)

            found = map_rows(rows, run, schema, "row", "pos", "entry", "part", rows=SLICE)
            out = found if out is None else out.unionByName(found)
        return out

    def update(self) -> None:
        """New entries: the floor of the mean of their members; an entry without members stays."""
        def add(row, pos, entry, x) -> tuple:
            key, back = np.unique(pos.astype(np.int64) << 32 | entry, return_inverse=True)
            sums = np.zeros((len(key), x.shape[1]), np.int64)
            np.add.at(sums, back, x)
            return (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32), _lists(sums, np.int64), np.bincount(back, minlength=len(key))

        found = self._members(add, "pos int, entry int, sums array<long>, n long")
        found = found.select("pos", "entry", "n", F.posexplode("sums").alias("i", "s"))
        new = self.books[-1].copy()
        for r in found.groupBy("pos", "entry", "i").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s"), F.sum("n").alias("n")).collect():  # at most entries * length of a vector rows
            new[r["pos"], r["entry"], r["i"]] = int(r["s"]) // r["n"]
        self.books.append(new)

    def migrate(self) -> None:
        """Members that the last codebook has brought nearer to another entry go to its owner; all others stay."""
        book, salts = self.books[-1], self.salts

        def moved(row, pos, entry, x) -> tuple:
            now = _by_position(pos, x, book)[0]
            go = now != entry
            return row[go], pos[go], now[go], _salted(row[go], salts), _lists(x[go], np.int32)

        self.deals.append(self._dealt(self._members(moved, MEMBER), f"arrivals{len(self.deals)}"))
        self.settled = len(self.books) - 1

    def assigned(self) -> DataFrame:
        """row, pos, entry, distance of every part under the last codebook."""
        book = self.books[-1]
        return self._members(lambda row, pos, entry, x: (row, pos, *_by_position(pos, x, book)), "row long, pos int, entry int, distance long")


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), width)


def books_digest(books: np.ndarray) -> str:
    return sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """id_col, code, error, label_error, codebooks_sha256 for every row with a usable vector.

    Rows whose vector is null or holds null or non-finite components are left out. Vectors shorter than the longest, or
    of a length that the parts do not divide, count as if zeros followed; components stay within +-MOST / SCALE. Rows that
    repeat are vectors of their own with the same code. Codebooks start with the smallest ids (null ids last; rows of one
    id by their components); with fewer rows than entries they are shorter. Null labels are one label; other columns are
    ignored. An empty table gives no rows.
    """
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).isNull().alias("bare"), F.coalesce(F.col(label_col).cast("string"), F.lit("")).alias("label"), x.alias("v")).filter(_usable(F.col("v")))
    kind = dict(rows.dtypes)["id"]
    integers = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", "bare", "label", integers.alias("v"))
    rows = store(rows, "lloyd-vectors")
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    schema = f"{id_col} {kind}, code string, error bigint, label_error bigint, codebooks_sha256 string"
    if not shape["n"]:
        return df.sparkSession.createDataFrame([], schema)
    width = -(-shape["dim"] // parts)
    padded = F.concat("v", F.array_repeat(F.lit(0), F.lit(parts * width) - F.size("v")))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = np.zeros((len(first), parts * width), np.int64)
    for i, r in enumerate(first):
        start[i, : len(r["v"])] = r["v"]
    model = Lloyd(rows.select("row", padded.alias("v")), start.reshape(len(first), parts, width).transpose(1, 0, 2), parts, shape["n"])
    for k in range(rounds):
        if k:
            model.migrate()
        model.update()
    two = F.lower(F.lpad(F.hex("entry"), 2, "0"))
    found = model.assigned().select("row", F.struct("pos", two.alias("hex")).alias("c"), "distance")
    found = found.groupBy("row").agg(F.array_sort(F.collect_list("c")).alias("c"), F.sum("distance").alias("error"))  # one row per part
    coded = rows.select("row", "id", "bare", "label").join(found.hint("merge"), "row").select("id", "bare", "label", F.array_join(F.transform("c", lambda c: c["hex"]), "").alias("code"), "error")
    coded = store(coded, "lloyd-codes")
    total = coded.groupBy("bare", "label").agg(F.sum(F.col("error").cast("decimal(20,0)")).cast("long").alias("label_error"))
    out = coded.join(sized(store(total, "lloyd-labels")), ["bare", "label"])
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books_digest(model.books[-1])).alias("codebooks_sha256"))


def op13_member_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _round(k: int) -> str:
    """Nearest entries under codebook k - 1, and codebook k."""
    return f"""
a{k} AS (SELECT p.vec_id, p.pos, min(struct_pack(d := list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := c.entry)).e AS entry FROM p JOIN c{k - 1} c USING (pos) GROUP BY ALL),
s{k} AS (SELECT a.pos, a.entry, i, (sum(p.v[i]) - ((sum(p.v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM a{k} a JOIN p USING (vec_id, pos), range(1, (SELECT max(len(v)) FROM p) + 1) r(i) GROUP BY ALL),
c{k} AS (SELECT c.pos, c.entry, coalesce(n.v, c.v) AS v FROM c{k - 1} c LEFT JOIN (SELECT pos, entry, list(m::BIGINT ORDER BY i) AS v FROM s{k} GROUP BY ALL) n USING (pos, entry))"""


ORACLE = (f"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, pos, v[(pos * len(v) // {PARTS} + 1):((pos + 1) * len(v) // {PARTS})] AS v FROM e, range({PARTS}) r(pos)),
c0 AS (SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS entry, v FROM p WHERE vec_id IN (SELECT vec_id FROM e ORDER BY vec_id LIMIT {ENTRIES})),"""
    + ",".join(_round(k) for k in range(1, ROUNDS + 1)) + f""",
f AS (SELECT p.vec_id, p.pos, min(struct_pack(d := list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := c.entry)) AS m FROM p JOIN c{ROUNDS} c USING (pos) GROUP BY ALL),
g AS (SELECT vec_id, string_agg(lower(printf('%02x', m.e)), '' ORDER BY pos) AS code, sum(m.d)::BIGINT AS error FROM f GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY pos, entry)) FROM c{ROUNDS}) AS codebooks_sha256
FROM g JOIN e USING (vec_id)""")  # fmt: skip
