"""Operator 2: exact n-gram Jaccard join with token-combination prefixes.

A document's set holds the 64-bit hashes of its distinct five-word shingles; hash order is the global token order.
 1. Documents with the same set are one text from here on (its smallest doc_id stands for it).
 2. A prefix is so many of a text's least tokens that a linked text must share one of them. Tokens of prefixes are
    counted over all texts. Each text joins the family of the most central text that shares a good part of its prefix,
    and families are verified block by block, so that copies of one another stop counting as different.
 3. A token is frequent when it would pair more than PAIRS texts of different families and components, else rare. Rare
    tokens are indexed alone. A prefix with too few rare tokens is extended until it has enough; where the whole set has
    too few, the frequent tokens are split into hash classes and combinations of two tokens of a class are indexed.
 4. The texts of an index entry meet in one task (many of them in blocks). Of texts of different families and components
    only those leave it as a pair whose set sketches do not rule a link out; these are verified on their whole sets.
Nothing is dropped: the pairs not formed were verified in their family, or lie in one component and cannot change it, or
have sketches that prove that too many tokens differ.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from smishlake.llm.common import grouped, map_rows, sized, store, table, unused, whole_groups
from smishlake.llm.graphs import components

WORDS = 5
#: A token that pairs more texts of different families and components than this is frequent.
PAIRS = 1 << 15
#: Prefixes are longer than need be by this factor, so that few must be extended.
SLACK = 1.1
#: A text may join the family of a text with which it shares at least this part of the shorter prefix.
FAMILY_SHARE = 1 / 3
#: Sizes of linked texts differ by a factor of 1.25 at most, so by one band of this factor at most.
BAND = 1.26
#: Tokens and texts in a block of a family at most, and distinct tokens in a stretch of a matrix product.
BLOCK_TOKENS, BLOCK_TEXTS, STRETCH = 1 << 17, 512, 4096
#: Texts of an index entry that meet in one task; more are dealt into blocks. Pairs that a task looks at at once.
ENTRY, CHUNK = 4096, 1 << 18
#: Hash classes of frequent tokens by set size; a set near a border is indexed on both sides of it.
CLASSES = ((160, 1), (4000, 32), (1 << 62, 1024))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def forget() -> None:
    """Gives back what a task has cached."""
    _HASHES.clear()


_ODD = np.random.default_rng(5).integers(1 << 40, 1 << 62, WORDS, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles (fewer words: the whole sequence; none: nothing)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1) - (1 << 63)], np.int64)
    w = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    h = np.zeros(n, np.uint64)
    for j in range(WORDS):
        h += (w[j : j + n] ^ (w[j : j + n] >> np.uint64(32))) * _ODD[j]
    s = np.sort(_mix(h).view(np.int64))
    keep = np.ones(n, bool)
    keep[1:] = s[1:] != s[:-1]
    return s[keep]


def sketch_of(s: np.ndarray) -> bytes:
    """Parity bits of a set: each token flips one. Two sets differ in at least as many tokens as their sketches in bits.

    The number of bits is a power of two, the set's size or more; a sketch is folded to half its length by xor.
    """
    bits = max(128, 1 << (len(s) - 1).bit_length()) if len(s) else 128
    flips = np.bincount((s.view(np.uint64) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def spare(n: int) -> int:
    """How many tokens of a set of n may be missing from a set that it links with."""
    return n - (4 * n + 4) // 5


def prefix_size(n: int) -> int:
    return min(n, int(np.ceil(SLACK * (spare(n) + 1))))


def levels(n: int) -> list[int]:
    """Class counts under which a set of n is indexed: those of every size it can link with."""
    low, high = (4 * n + 4) // 5, (5 * n) // 4
    out, start = [], 0
    for end, classes in CLASSES:
        if start <= high and low < end:
            out.append(classes)
        start = end
    return out


def extension(s: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rare tokens beyond the prefix, combinations) that a set needs besides its prefix, given its frequent tokens."""
    n, p = len(s), prefix_size(len(s))
    need = spare(n) + 1
    none = np.zeros(0, np.int64)
    if not len(frequent) or not n:
        return none, none
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    often = frequent[at] == s
    rare = int((~often[:p]).sum())
    if rare >= need:
        return none, none
    more = s[p:][~often[p:]][: need - rare]
    if rare + len(more) >= need:
        return more, none
    # the whole set has too few rare tokens: classes of frequent tokens, two of a class together
    left = need - rare - len(more)
    f = s[often]
    out = []
    for classes in levels(n):
        c = _mix(f.view(np.uint64) + np.uint64(classes)) % np.uint64(classes)
        have, members = 0, {}
        for t, k in zip(f.tolist(), c.tolist(), strict=True):
            m = members.setdefault(k, [])
            m.append(t)
            have += len(m) > 1
            if have >= left:
                break
        tag = classes * 0x9E3779B97F4A7C15
        for m in members.values():
            out += [((a * 0xC2B2AE3D27D4EB4F) ^ (b * 0x165667B19E3779F9) ^ tag) & ((1 << 64) - 1) for a, b in combinations(m, 2)]
    return more, np.unique(_mix(np.array(out, np.uint64)).view(np.int64)) if out else none


def sets_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, s: whole sets of the documents whose id is listed."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(sized(ids), "id", "left_semi")
    return map_rows(rows, lambda i, t: (i, [shingles(x) for x in t]), "id long, s array<long>", "id", "text", after=forget)


def verify(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    pairs = store(pairs.select("a", "b").distinct(), "jaccard-pairs")
    ids = store(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "jaccard-ids")
    sets = store(sets_of(docs, ids, id_col, text_col), "jaccard-sets")
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")).hint("merge"), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")).hint("merge"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(9 * shared >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def block_links(ids: np.ndarray, sets: list[np.ndarray], other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside a block, or between the two blocks that `other` tells apart, as (member, least id it connects to).

    Intersections are matrix products over stretches of the tokens that two sets or more share.
    """
    n, sizes = len(ids), np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    _, at, df = np.unique(tokens, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    often = df[at] > 1
    row, at = row[often], at[often]
    if not len(at):
        return ids[:0], ids[:0]
    at = np.unique(at, return_inverse=True)[1]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    both = np.zeros((n, n), np.float32)
    for low in range(0, int(at[-1]) + 1, STRETCH):
        a, b = np.searchsorted(at, (low, low + STRETCH))
        m = np.zeros((n, min(STRETCH, int(at[-1]) + 1 - low)), np.float32)
        m[row[a:b], at[a:b] - low] = 1
        both += m @ m.T
    small = sizes.astype(np.int32)
    linked = 9 * both.astype(np.int32) >= 4 * (small[:, None] + small[None, :])
    np.fill_diagonal(linked, False)
    if other.any():
        linked &= other[:, None] != other[None, :]
    label = ids.copy()
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(1))
        if (low == label).all():
            break
        label = low
    hit = label != ids
    return ids[hit], label[hit]


def dealt(rows: DataFrame, blocks: Column) -> DataFrame:
    """Rows with one, two and mine: a key's rows are dealt into blocks by hash of id, and every two blocks meet once."""
    rows = rows.withColumn("blocks", blocks.cast("int")).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("one", F.least("mine", "theirs")).withColumn("two", F.greatest("mine", "theirs")).drop("theirs", "blocks")


def verify_families(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links a, b that connect what links inside each family; members(fam, id, n).

    A family is dealt into blocks of about BLOCK_TOKENS tokens or BLOCK_TEXTS texts and every two blocks meet in one task,
    so a family of any size is compared without writing its pairs out.
    """
    members = store(members.groupBy("fam", "id").agg(F.max("n").alias("n")), "jaccard-members")
    sizes = members.groupBy("fam").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("tokens")).filter("m > 1")
    sizes = store(sizes.select("fam", F.ceil(F.greatest(F.col("tokens") / BLOCK_TOKENS, F.col("m") / BLOCK_TEXTS)).cast("int").alias("deal")), "jaccard-sizes")
    placed = dealt(members.select("fam", "id").join(sized(sizes), "fam"), F.col("deal")).drop("deal")
    ids = store(members.select("id").distinct(), "jaccard-ids")
    sets = sets_of(docs, ids, id_col, text_col)
    key = ["fam", "one", "two"]
    tasks = placed.join(sets.hint("merge"), "id").repartition(*key).sortWithinPartitions(*key)

    def flush(rows: pa.Table):
        one, two = rows["one"][0].as_py(), rows["two"][0].as_py()
        other = rows["mine"].to_numpy() == two if one != two else np.zeros(rows.num_rows, bool)
        if rows.num_rows < 2 or one != two and (other.all() or not other.any()):
            return None
        lists = rows["s"].combine_chunks()
        flat, ends = lists.flatten().to_numpy(), np.cumsum(np.diff(lists.offsets.to_numpy()))
        sets = [flat[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]
        a, b = block_links(rows["id"].to_numpy(), sets, other)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"]) if len(a) else None

    return tasks.mapInArrow(lambda batches: grouped(batches, key, flush), "a long, b long")


def may_link(i: np.ndarray, j: np.ndarray, n: np.ndarray, sketches: list[bytes]) -> np.ndarray:
    """Which pairs i, j of rows have sketches near enough for a link: linked sets of sizes n differ in (n_i + n_j) / 9 tokens at most."""
    out = np.zeros(len(i), bool)
    size = np.array([len(x) for x in sketches])
    small = np.minimum(size[i], size[j])
    for length in np.unique(small):
        at = np.flatnonzero(small == length)
        rows, back = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
        m = np.zeros((len(rows), int(length) // 8), np.uint64)
        for k, r in enumerate(rows):
            x = np.frombuffer(sketches[r], np.uint64)
            m[k] = np.bitwise_xor.reduce(x.reshape(-1, m.shape[1]), axis=0)
        differ = np.bitwise_count(m[back[: len(at)]] ^ m[back[len(at) :]]).sum(1, dtype=np.int64)
        out[at] = 9 * differ <= n[i[at]] + n[j[at]]
    return out


def meet(index: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs a < b that share an index entry, of different families and components, and that their sketches let link.

    index(h, id, n, comp, fam); texts(id, sketch). An entry is split by size, each text in its own size band and the next,
    so that any two that may link meet; entries whose texts are all of one family or component are left out.
    """
    band = F.floor(F.log(F.col("n")) / float(np.log(BAND)))
    index = index.withColumn("h", F.explode(F.array(F.xxhash64("h", band), F.xxhash64("h", band + 1))))
    entries = index.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("fam").alias("f1"), F.max("fam").alias("f2"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
    entries = entries.filter("f1 <> f2 AND c1 <> c2").select("h", "m")
    rows = dealt(index.join(entries.hint("merge"), "h").join(texts.hint("merge"), "id"), F.ceil(F.col("m") / ENTRY)).drop("m")
    key = ["h", "one", "two"]
    tasks = rows.repartition(*key).sortWithinPartitions(*key, "fam")

    def pairs_of(rows: pa.Table):
        col = lambda c: rows[c].to_numpy(zero_copy_only=False)
        h, one, two, mine, ids, n, comp, fam = map(col, (*key, "mine", "id", "n", "comp", "fam"))
        n = n.astype(np.int64)
        sketches = rows["sketch"].to_pylist()
        edge = np.r_[True, (h[1:] != h[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
        kin = edge | np.r_[True, fam[1:] != fam[:-1]]
        ends = lambda marks: np.r_[np.flatnonzero(marks)[1:], len(h)][np.cumsum(marks) - 1]
        start, count = ends(kin), ends(edge) - ends(kin)  # partners of a row: the rows of its entry behind its own family
        done, total = 0, np.cumsum(count)
        while done < len(h):
            to = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + CHUNK, "right")))
            c = count[done:to]
            i = np.repeat(np.arange(done, to), c)
            j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + start[i]
            done = to
            fine = (comp[i] != comp[j]) & (fam[i] != ids[j]) & (fam[j] != ids[i]) & (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j]))
            fine &= (one[i] == two[i]) | (mine[i] != mine[j])
            i, j = i[fine], j[fine]
            if len(i):
                near = may_link(i, j, n, sketches)
                a, b = ids[i[near]], ids[j[near]]
                if len(a):
                    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    def run(batches):
        for rows in whole_groups(batches, key):
            yield from pairs_of(rows)

    return tasks.mapInArrow(run, "a long, b long")


def head_size(n: str) -> Column:
    """prefix_size() as a column."""
    return F.expr(f"least({n}, CAST(ceil({SLACK}D * ({n} - (4 * {n} + 4) DIV 5 + 1)) AS INT))")


def families(shared: DataFrame) -> DataFrame:
    """fam, id, n: each text that joins a family, and the most central text of it.

    shared(h, id, n, c) are the tokens of prefixes that stand in more than one of them, with their count. A text is the
    more central the more of its prefix is shared, and the more often; each token offers the most central of the texts
    of about one size that have it.
    """
    band = F.floor(F.log(F.col("n")) / float(np.log(BAND))).cast("int")
    weight = shared.groupBy("id").agg((F.sum(F.log2("c")) / F.max(head_size("n"))).alias("w"))
    weighed = store(shared.join(weight.hint("merge"), "id").select("h", "id", "n", "w", band.alias("band")), "jaccard-weighed")
    centre = weighed.groupBy("h", "band").agg(F.max(F.struct("w", (-F.col("id")).alias("neg"), "n")).alias("x"))
    centre = centre.select("h", "band", (-F.col("x.neg")).alias("fam"), F.col("x.n").alias("fam_n"))
    near = weighed.join(centre.hint("merge"), ["h", "band"]).filter("id <> fam").groupBy("id", "fam").agg(F.count(F.lit(1)).alias("got"), F.first("n").alias("n"), F.first("fam_n").alias("fam_n"))
    near = near.filter(F.col("got") >= FAMILY_SHARE * F.least(head_size("n"), head_size("fam_n")))
    best = near.groupBy("id").agg(F.max(F.struct("got", (-F.col("fam")).alias("neg"), "n", "fam_n")).alias("x"))
    return best.select("id", F.col("x.n").alias("n"), (-F.col("x.neg")).alias("fam"), F.col("x.fam_n").alias("fam_n"))


def crossing(rows: DataFrame, by: str) -> DataFrame:
    """h, pairs: how many pairs of rows(h, ...) with that token differ in `by`; tokens with none are left out."""
    parts = rows.groupBy("h", by).agg(F.count(F.lit(1)).alias("c"))
    each = parts.groupBy("h").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("cc"), F.count(F.lit(1)).alias("parts"))
    return each.filter("parts > 1").select("h", ((F.col("c") * F.col("c") - F.col("cc")) / 2).alias("pairs"))


def frequent_tokens(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(tokens that cross families, and of these the frequent ones: more than PAIRS pairs cross families, and components too)."""
    spread = store(crossing(rows, "fam"), f"{name}-spread")
    many = spread.filter(F.col("pairs") > PAIRS).select("h")
    often = crossing(rows.join(sized(many), "h", "left_semi"), "comp").filter(F.col("pairs") > PAIRS).select("h")
    return spread.select("h"), store(often, f"{name}-frequent")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id for every row: components of "Jaccard of the shingle sets is 0.8 or more".

    Null texts, empty texts and texts without words have an empty set and link with nothing. Ids are taken as unique;
    rows that repeat an id with the same text get the same answer. Other columns are ignored.
    """
    docs = df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col))

    def sketched(ids: list, texts: list) -> tuple:
        k1, k2, n, head, sketch = [], [], [], [], []
        for t in texts:
            s = shingles(t)
            key = xxhash.xxh3_128_intdigest(s.tobytes())
            k1.append((key >> 64) - (1 << 63))
            k2.append((key & ((1 << 64) - 1)) - (1 << 63))
            n.append(len(s))
            head.append(s[: prefix_size(len(s))])
            sketch.append(sketch_of(s))
        return ids, n, k1, k2, head, sketch

    t = store(map_rows(docs, sketched, "id long, n int, k1 long, k2 long, head array<long>, sketch binary", id_col, text_col, after=forget), "jaccard-sketch")
    groups = store(t.filter("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("id")), "jaccard-groups")
    copies = t.filter("n > 0").select("id", "k1", "k2").join(groups.withColumnRenamed("id", "first").hint("merge"), ["k1", "k2"]).filter("id <> first")
    texts = t.filter("n > 0").join(sized(store(copies.select("id"), "jaccard-copies")), "id", "left_anti")
    tokens = texts.select("id", "n", F.explode("head").alias("h"))
    twice = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    shared = store(tokens.join(twice.hint("merge"), "h").select("h", "id", "n", "c"), "jaccard-tokens")

    family = store(families(shared), "jaccard-families")
    members = family.select("fam", "id", "n").unionByName(family.select("fam", F.col("fam").alias("id"), F.col("fam_n").alias("n")))
    links = store(verify_families(docs, members, id_col, text_col), "jaccard-links")
    near = components(links)
    kin = family.select("id", "fam").join(near.select(F.col("node").alias("id"), "component").hint("merge"), "id", "full_outer")
    kin = store(kin.select("id", F.coalesce("component", "id").alias("component"), F.coalesce("fam", "id").alias("family")), "jaccard-kin")

    placed = store(_kindred(shared.select("h", "id", "n"), kin), "jaccard-placed")
    spread, frequent = frequent_tokens(placed, "jaccard-prefix")
    index = placed.join(spread.hint("merge"), "h", "left_semi").join(sized(frequent), "h", "left_anti")
    wanting = _wanting(placed, frequent)
    if not wanting.isEmpty():
        index = index.unionByName(_extended(docs, tokens, placed, kin, frequent, wanting, id_col, text_col)).distinct()
    pairs = meet(index, texts.select("id", "sketch").dropDuplicates(["id"]))
    links = links.unionByName(verify(docs, pairs, id_col, text_col))
    whole = components(links)

    found = groups.join(whole.select(F.col("node").alias("id"), "component").hint("merge"), "id", "left")
    found = found.select("k1", "k2", F.coalesce("component", "id").alias("component_id"))
    full = t.filter("n > 0").select("id", "n", "k1", "k2").join(found.hint("merge"), ["k1", "k2"]).select("id", "n", "component_id")
    out = full.unionByName(t.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def _wanting(placed: DataFrame, frequent: DataFrame) -> DataFrame:
    """id, missing: the texts whose prefix has too few rare tokens, and how many more they need."""
    often = placed.join(sized(frequent), "h", "left_semi").groupBy("id").agg(F.count_distinct("h").cast("int").alias("often"), F.first("n").alias("n"))
    missing = F.expr("n - (4 * n + 4) DIV 5 + 1") - (head_size("n") - F.col("often"))
    return store(often.withColumn("missing", missing.cast("int")).filter("missing > 0").select("id", "missing"), "jaccard-wanting")


def _extended(docs: DataFrame, tokens: DataFrame, placed: DataFrame, kin: DataFrame, frequent: DataFrame, wanting: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Index rows that the wanting texts need besides their prefixes, and the rows that these may meet.

    The tokens behind a prefix are counted before they are used, so that what is frequent there counts as frequent too;
    any set of frequent tokens gives whole results as long as all texts go by the same one. Texts that still lack rare
    tokens are few; their whole sets are looked at.
    """
    def peek(ids: list, missing: list, texts: list) -> tuple:
        n, window = [], []
        for m, x in zip(missing, texts, strict=True):
            s = shingles(x)
            p = prefix_size(len(s))
            n.append(len(s))
            window.append(s[p : p + m + m // 4 + 4])
        return ids, n, missing, window

    windows = own = others = None
    while True:
        new = wanting if windows is None else wanting.join(windows.select("id").hint("merge"), "id", "left_anti")
        if new.isEmpty():
            break
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sized(new), "id")
        peeked = store(map_rows(rows, peek, "id long, n int, missing int, window array<long>", "id", "missing", "text", after=forget), "jaccard-windows")
        behind = store(peeked.select(F.explode("window").alias("h"), "id", "n"), "jaccard-behind")
        heads = behind.select("h").distinct() if own is None else behind.select("h").distinct().join(own.select("h").distinct().hint("merge"), "h", "left_anti")
        met = store(tokens.join(sized(store(heads, "jaccard-heads")), "h", "left_semi").select("h", "id", "n"), "jaccard-others")
        windows, own, others = (x if y is None else y.unionByName(x) for x, y in ((peeked, windows), (behind, own), (met, others)))
        frequent = store(frequent.unionByName(frequent_tokens(_kindred(own.unionByName(others), kin), "jaccard-behind")[1]).distinct(), "jaccard-frequent")
        wanting = _wanting(placed, frequent)
    fresh = own.join(sized(frequent), "h", "left_anti").groupBy("id").agg(F.sort_array(F.collect_list("h")).alias("fresh"))
    ready = windows.drop("missing").join(wanting.hint("merge"), "id").join(fresh.hint("merge"), "id", "left").select("id", "n", F.slice(F.coalesce("fresh", F.array().cast("array<long>")), 1, F.col("missing")).alias("more"), "missing")
    ready = store(ready, "jaccard-ready")
    out = ready.filter("size(more) = missing").select(F.explode("more").alias("h"), "id", "n")
    lacking = ready.filter("size(more) < missing").select("id")
    if not lacking.isEmpty():
        sets = store(sets_of(docs, lacking, id_col, text_col), "jaccard-whole")
        often = sets.select("id", F.explode("s").alias("h")).join(sized(frequent), "h").groupBy("id").agg(F.sort_array(F.collect_set("h")).alias("often"))

        def extend(ids: list, sets, often) -> tuple:
            found = [extension(sets[k].values.to_numpy(), often[k].values.to_numpy()) for k in range(len(ids))]
            return ids, [len(x) for x in sets], [m for m, _ in found], [c for _, c in found]

        wide = store(map_rows(sets.join(often.hint("merge"), "id"), extend, "id long, n int, more array<long>, combos array<long>", "id", "s", "often"), "jaccard-extended")
        rest = wide.select(F.explode("more").alias("h"), "id", "n")
        others = others.unionByName(tokens.join(sized(rest.select("h").distinct()), "h", "left_semi").select("h", "id", "n"))
        out = out.unionByName(rest).unionByName(wide.select(F.explode("combos").alias("h"), "id", "n"))
    out = store(out, "jaccard-extensions")
    met = others.join(sized(out.select("h").distinct()), "h", "left_semi")
    return _kindred(out.unionByName(met), kin)


def _kindred(rows: DataFrame, kin: DataFrame) -> DataFrame:
    """rows(h, id, n) with comp and fam; a text without kin is its own."""
    out = rows.join(sized(kin), "id", "left")
    return out.select("h", "id", "n", F.coalesce("component", "id").alias("comp"), F.coalesce("family", "id").alias("fam"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stand for their group (doc_id equals component_id), with their own columns of any names.

    Of rows that repeat a doc_id, all stay; a null doc_id stays.
    """
    name = unused("id", docs)
    gone = store(near_duplicates(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct(), "dropped-copies")
    return docs.join(sized(gone), F.col("doc_id").cast("long") == F.col(name), "left_anti")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
common AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
sc AS (SELECT s.* FROM s JOIN common USING (g)),
p AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sc x JOIN sc y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
r AS (WITH RECURSIVE c(node, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT c.node, p.b FROM c JOIN p ON p.a = c.reach) SELECT node, min(reach) AS component_id FROM c GROUP BY node)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM documents d JOIN r ON r.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
