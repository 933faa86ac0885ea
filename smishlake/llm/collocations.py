"""Operator 11: phrase collocations, counted in HAT-tries.

Phrases of one and of two words are counted in a pass each, all longer ones in one more, and a pass looks only at
phrases all of whose parts, of the length of the pass before, may be frequent. What may be frequent is told by a bit array
of bounded size that is broadcast: a frequent phrase always has its bit, so the sieve loses nothing, and a bit that others
share costs a phrase that is counted and dropped again.

A task counts in a HAT-trie: word ids lead down a shallow trie to hash containers of the ids that remain; a container that
grows beyond BURST entries bursts into a node with a container for each next word. When the trie is full, its largest
subtrees leave as sorted runs until half of it is free. Runs are dealt by prefix (the first word, split into salts by the
words behind it) and merged there in the order of phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from smishlake.llm.common import sized, store, table

WORDS, LEAST, SHARE, TOP = 5, 100, 100, 2000
#: Entries of a container before it bursts, and of a trie before it spills; distinct words of a task before it starts anew;
#: characters of text that are counted at once. Up to SIEVED words, phrases of each length have a pass of their own.
BURST, FULL, VOCABULARY, TEXT, SIEVED = 4096, 600_000, 450_000, 2_000_000, 2
#: Parts of a prefix; bits of a sieve for each frequent phrase, and at most.
SALTS, BITS_EACH, MOST_BITS = 16, 32, 1 << 30
#: Parts of what joins and ranks by one phrase or language.
DEAL = 16
#: What stands for a break between pieces, and small letters for large ones; words are then what stands between spaces.
BREAK, SPACED = b".", b" . "
PLAIN = bytes.maketrans(b",;:!?\n\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"......... abcdefghijklmnopqrstuvwxyz")
_ODD = np.random.default_rng(11).integers(1 << 40, 1 << 62, 8, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hash(word: bytes, lang: str) -> int:
    return xxhash.xxh3_64_intdigest(word, xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; words are hashes of words in their language."""
    n = max(0, len(words) - k + 1)
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h += (words[j : j + n] ^ (words[j : j + n] >> np.uint64(32))) * _ODD[j]
    return _mixed(h)


def window_hashes_at(words: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """window_hashes() of the given places only; words are the hashes of the ids."""
    h = np.full(len(at), k, np.uint64)
    for j in range(k):
        w = words[ids[at + j]]
        h += (w ^ (w >> np.uint64(32))) * _ODD[j]
    return _mixed(h)


def may_be(sieve: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit in a sieve."""
    at = hashes & np.uint64(len(sieve) * 64 - 1)
    return (sieve[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def word_may_be(sieve: np.ndarray, word: int) -> bool:
    """may_be() of one word by its hash, without arrays."""
    full = (1 << 64) - 1
    h = (1 + (word ^ word >> 32) * int(_ODD[0])) & full
    h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & full
    h = ((h ^ h >> 27) * 0x94D049BB133111EB) & full
    at = (h ^ h >> 31) & (len(sieve) * 64 - 1)
    return bool(int(sieve[at >> 6]) >> (at & 63) & 1)


class HatTrie:
    """Counts of phrases of k words, keyed by the bytes of their word ids.

    A container is a dict from the ids that remain (bytes) to a count; a Node is a dict from an id (bytes) to what follows:
    containers, or one more level of nodes.
    """

    class Node(dict):
        pass

    def __init__(self, k: int, burst: int = BURST):
        self.k, self.limit, self.root, self.size = k, burst, {}, 0

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """Distinct rows of k ids in their order, with their counts."""
        n = counts.tolist()
        if type(self.root) is dict:
            self.root = self._filled(self.root, _keys(ids), n, self.k)
            return
        starts = np.r_[0, np.flatnonzero(np.diff(ids[:, 0])) + 1]
        rests, root = _keys(ids[:, 1:]), self.root
        for step, at, end in zip(_keys(ids[starts, :1]), starts.tolist(), [*starts[1:].tolist(), len(n)], strict=True):
            node = root.get(step)
            if type(node) is HatTrie.Node:
                for rest, c in zip(rests[at:end], n[at:end], strict=True):
                    below = node.setdefault(rest[:4], {})
                    self.size += rest[4:] not in below
                    below[rest[4:]] = below.get(rest[4:], 0) + c
            else:
                root[step] = self._filled({} if node is None else node, rests[at:end], n[at:end], self.k - 1)

    def _filled(self, container: dict, keys: list[bytes], counts: list[int], words: int) -> dict:
        """A container with more keys of so many words, burst where it has grown beyond its limit."""
        before, get = len(container), container.get
        for key, c in zip(keys, counts, strict=True):
            container[key] = get(key, 0) + c
        self.size += len(container) - before
        if len(container) <= self.limit or words < 2:
            return container
        new = HatTrie.Node()
        for key, c in container.items():
            new.setdefault(key[:4], {})[key[4:]] = c
        return new

    @staticmethod
    def _weight(node: dict) -> int:
        return sum(map(HatTrie._weight, node.values())) if type(node) is HatTrie.Node else len(node)

    @staticmethod
    def _gather(node: dict, prefix: bytes, keys: list[bytes], counts: list[int]) -> None:
        if type(node) is HatTrie.Node:
            for step, below in node.items():
                HatTrie._gather(below, prefix + step, keys, counts)
        else:
            keys += [prefix + rest for rest in node]
            counts += node.values()

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of the largest subtrees, which leave until `keep` entries at most are left; a root that is a
        container leaves whole."""
        keys: list[bytes] = []
        counts: list[int] = []
        if type(self.root) is HatTrie.Node and keep:
            weight = {step: self._weight(below) for step, below in self.root.items()}
            for step in sorted(weight, key=weight.__getitem__, reverse=True):
                if self.size <= keep:
                    break
                self._gather(self.root.pop(step), step, keys, counts)
                self.size -= weight[step]
        else:
            self._gather(self.root, b"", keys, counts)
            self.root, self.size = {}, 0
        return np.frombuffer(b"".join(keys), "<u4").reshape(-1, self.k), np.array(counts, np.int64)


def _keys(ids: np.ndarray) -> list[bytes]:
    """Rows of ids as bytes."""
    return np.ascontiguousarray(ids.astype("<u4")).view(f"V{4 * ids.shape[1]}").ravel().tolist()


class _Words(dict):
    """Ids of the words of one language; a break, or a word that the sieve of single words stops, is -1."""

    def __init__(self, counter: Counter, lang: str):
        self.counter, self.lang = counter, lang

    def __missing__(self, token: bytes) -> int:
        c = self.counter
        h = word_hash(token, self.lang)
        if token == BREAK or c.sieves and not word_may_be(c.sieves[0], h):
            self[token] = -1
            return -1
        self[token] = i = len(c.words)
        c.words.append(token)
        c.hashes.append(h)
        c.langs.append(self.lang)
        return i


class Counter:
    """Counts the phrases of the given lengths in the texts of a task; runs come out as record batches sorted by key.

    sieves are of single words, and of phrases of `part` words: of longer phrases only those are counted all of whose parts
    of that length may be frequent.
    """

    SCHEMA = "key string, n long"

    def __init__(self, lengths: tuple[int, ...], sieves: tuple = (), part: int = 1):
        self.sieves, self.part, self.limit = sieves, part, FULL
        self.tries, self.totals = {k: HatTrie(k) for k in lengths}, {}
        self._anew()

    def _anew(self) -> None:
        self.words, self.hashes, self.langs, self.ids = [], [], [], {}

    def count(self, langs: list, texts: list) -> None:
        whole: dict[str, list[bytes]] = {}
        for lang, text in zip(langs, texts, strict=True):
            whole.setdefault("und" if lang is None else lang, []).append((text or "").encode("utf-8", "surrogatepass"))
        for lang, found in whole.items():
            known = self.ids.setdefault(lang, _Words(self, lang))
            tokens = SPACED.join(found).translate(PLAIN).replace(BREAK, SPACED).split()
            ids = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
            if 1 in self.tries:
                self.totals[lang] = self.totals.get(lang, 0) + int((ids >= 0).sum())
            self._windows(ids)

    def _windows(self, ids: np.ndarray) -> None:
        fine = ids >= 0
        part = fine
        if self.part > 1 and len(ids) >= self.part:
            n = len(ids) - self.part + 1
            some = np.flatnonzero(np.logical_and.reduce([fine[j : j + n] for j in range(self.part)]))
            part = np.zeros(n, bool)
            hashes = np.array(self.hashes or [0], np.uint64)
            part[some] = may_be(self.sieves[1], window_hashes_at(hashes, ids, some, self.part))
        for k, trie in self.tries.items():
            n = len(ids) - k + 1
            if n <= 0:
                continue
            at = np.flatnonzero(np.logical_and.reduce([part[j : j + n] for j in range(k - self.part + 1)]))
            if not len(at):
                continue
            code = ids[at]
            for j in range(1, k):
                if j > 1:
                    code = np.unique(code, return_inverse=True)[1].astype(np.int64)
                code = code << 32 | ids[at + j]
            _, first, counts = np.unique(code, return_index=True, return_counts=True)
            where = at[first]
            trie.add(np.stack([ids[where + j] for j in range(k)], 1), counts)

    def runs(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """What has to leave now: nothing while there is room, all at the end or when there are too many words."""
        anew = last or sum(map(len, self.ids.values())) > VOCABULARY
        for trie in sorted(self.tries.values(), key=lambda t: -t.size):
            if trie.size and (anew or sum(t.size for t in self.tries.values()) > self.limit):
                yield self._run(*trie.spill(0 if anew else trie.size // 2))
        if anew:
            self._anew()
        if last and self.totals:
            yield self._batch(pa.array(["\t" + x for x in self.totals]), np.array(list(self.totals.values()), np.int64))

    def _run(self, ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        words, langs = pa.array(self.words, pa.binary()), pa.array(self.langs)
        phrase = pc.binary_join_element_wise(*(words.take(pa.array(c)) for c in ids.T), pa.scalar(b" ", pa.binary()))
        key = pc.binary_join_element_wise(phrase, langs.take(pa.array(ids[:, 0])).cast(pa.binary()), pa.scalar(b"\t", pa.binary()))
        order = pc.sort_indices(key)
        return self._batch(key.take(order).cast(pa.string()), counts[order.to_numpy()])

    @staticmethod
    def _batch(key: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([key, pa.array(n)], names=["key", "n"])


def merged(batches, least: int) -> Iterator[pa.RecordBatch]:
    """Sorted runs in one order: counts of equal keys are added up, phrases under `least` go, numbers of words stay."""
    key, n = None, 0

    def taken(keys: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        keep = pc.or_(pa.array(counts >= least), pc.starts_with(keys, "\t"))
        return pa.RecordBatch.from_arrays([keys.filter(keep), pa.array(counts).filter(keep)], names=["key", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, counts = batch.column(0), batch.column(1).to_numpy()
        starts = np.r_[0, np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1]
        sums = np.add.reduceat(counts, starts)
        names = keys.take(pa.array(starts))
        if key is not None and names[0].as_py() == key:
            sums[0] += n
        elif key is not None:
            yield taken(pa.array([key]), np.array([n], np.int64))
        key, n = names[-1].as_py(), int(sums[-1])
        if len(names) > 1:
            yield taken(names[:-1], sums[:-1])
    if key is not None:
        yield taken(pa.array([key]), np.array([n], np.int64))


def counted(docs: DataFrame, lang_col: str, text_col: str, lengths: tuple[int, ...], sieves: tuple, least: int) -> DataFrame:
    """key (phrase, tab, language), n: phrases of these lengths that stand `least` times or more; with single words also,
    without a phrase, how many words a language has. sieves are broadcast bit arrays of the frequent words and of the
    frequent phrases of one word less than the first length."""
    def count(batches) -> Iterator[pa.RecordBatch]:
        counter = Counter(lengths, tuple(s.value for s in sieves), max(1, lengths[0] - 1))
        langs, texts, size = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    langs.append(lang)
                    texts.append(text)
                    size += len(text or "")
                    if size > TEXT:
                        counter.count(langs, texts)
                        langs, texts, size = [], [], 0
                        yield from counter.runs()
        if langs:
            counter.count(langs, texts)
        yield from counter.runs(last=True)

    runs = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInArrow(count, Counter.SCHEMA)
    # a run is sorted when it comes; Spark merges the runs of a prefix and spills what does not fit
    dealt = runs.repartition(F.substring_index("key", " ", 1), F.pmod(F.xxhash64("key"), F.lit(SALTS))).sortWithinPartitions("key")
    return dealt.mapInArrow(lambda batches: merged(batches, least), "key string, n long")


def sieve_of(phrases: DataFrame, bits: int) -> np.ndarray:
    """Bit array (64 bits a word, a power of two of them) with a bit for each of phrases(phrase, lang)."""
    def place(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for phrase, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = np.array([word_hash(w, lang) for w in phrase.encode("utf-8", "surrogatepass").split(b" ")], np.uint64)
                out.append(int(window_hashes(words, len(words))[0]) & (bits - 1))
            at = np.array(out, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((at & 63).astype(np.int32))], names=["word", "bit"])

    words = phrases.select("phrase", "lang").mapInArrow(place, "word long, bit int").groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    found = words.toArrow()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def frequent(docs: DataFrame, lang_col: str, text_col: str, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(phrase, lang, k, f) of all phrases of up to `longest` words that stand `least` times, and (lang, n) of all words."""
    sc, sieves, levels, totals = docs.sparkSession.sparkContext, (), [], None
    passes = [(k,) for k in range(1, min(longest, SIEVED) + 1)] + [tuple(range(SIEVED + 1, longest + 1))]
    for lengths in filter(None, passes):
        rows = counted(docs, lang_col, text_col, lengths, sieves, least)
        rows = rows.select(F.substring_index("key", "\t", 1).alias("phrase"), F.expr("substr(key, instr(key, '\t') + 1)").alias("lang"), F.col("n").alias("f"))
        rows = store(rows.withColumn("k", F.size(F.split("phrase", " "))), f"phrases-{lengths[0]}")
        if lengths == (1,):
            totals, rows = rows.filter("phrase = ''").select("lang", F.col("f").alias("n")), rows.filter("phrase <> ''")
        levels.append(rows)
        if lengths == passes[-1] or not (n := rows.count()):
            break
        sieve = sc.broadcast(sieve_of(rows, min(MOST_BITS, max(1 << 16, 1 << (n * BITS_EACH - 1).bit_length()))))
        sieves = (sieves[0] if sieves else sieve, sieve)
    out = levels[0]
    for rows in levels[1:]:
        out = out.unionByName(rows)
    return out, totals


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = WORDS, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language.

    Every language is counted for itself (null: und); a null text counts as empty. Repeated rows count again, other columns
    are ignored, texts of any length are read whole. Of the cuts of a phrase the one with the lowest score counts, the
    earliest among equals; phrases inside a longer one that stands as often (share per cent of a) are left out. A table
    without phrases that are frequent enough gives no rows.
    """
    found, totals = frequent(docs, lang_col, text_col, longest, least)
    salts = F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))).alias("salt")
    salt = F.pmod(F.xxhash64("phrase"), F.lit(DEAL)).cast("int").alias("salt")
    part = lambda name, col: store(found.select(F.col("lang"), F.col("phrase").alias(name), F.col("f").alias(col), salts), f"phrases-{name}").hint("merge")  # noqa: E731  a word that begins very many phrases is spread over salts
    words = F.split("phrase", " ")
    candidates = found.filter("k > 1")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), salt, F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumn("left", F.array_join(F.slice(words, 1, F.col("cut")), " ")).withColumn("right", F.expr("substr(phrase, length(left) + 2)"))
    cuts = cuts.join(part("left", "l"), ["lang", "left", "salt"]).join(part("right", "r"), ["lang", "right", "salt"]).join(sized(totals), "lang")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    score = F.expr("(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    least_cut = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("x"))
    scored = least_cut.select("lang", "phrase", "x.*")
    inner = candidates.filter("k > 2").select("lang", words.alias("w"), "k", "f", F.explode(F.expr("sequence(2, k - 1)")).alias("size"))
    inner = inner.select("lang", "w", "f", "size", F.explode(F.expr("sequence(1, k - size + 1)")).alias("at"))
    inner = inner.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase")).agg(F.max("f").alias("longer"))
    kept = scored.join(inner.hint("merge"), ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * wide("longer") < share * wide("a")))
    kept = store(kept.select("lang", "phrase", "a", "l", "r", "n", "score", salt), "phrases-scored")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    best = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)  # top * DEAL rows of a language
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, {WORDS + 1}) r(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, phrase, f AS a, k, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n.n, cut, (1000::HUGEINT * c.a * n.n) // (x.f::HUGEINT * y.f) AS score
  FROM c JOIN range(1, {WORDS}) t(cut) ON cut < c.k JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ') JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT c.lang, array_to_string(c.w[o:o + size - 1], ' ') AS phrase, max(c.a) AS longer FROM c JOIN range(2, {WORDS}) z(size) ON size < c.k JOIN range(1, {WORDS + 1}) t(o) ON o + size - 1 <= c.k GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {SHARE} * a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= {TOP}
"""
