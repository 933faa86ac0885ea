"""Operator 12: byte-level BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

Texts are cut at added tokens, then into pieces by the transition-function scan of operator 9. The symbols of a piece are
the leaves of a segment tree that holds, for each symbol, the rank of the pair that it forms with the next one and where it
stands; the root is the least of them, so it names the leftmost pair of the lowest rank. A merge changes three leaves (the
pair, the symbol that went, the pair before), each by a walk to the root, until the root holds no pair. Pieces of a batch
that are not in the cache are merged side by side, one tree a row; long pieces have a tree each. Vocabulary, merges and
added tokens are read from a file of the tokenizers library.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from smishlake.llm.byte_bpe import batch_starts, vocabulary
from smishlake.llm.common import map_rows, table

FILE = "byte_bpe_50k.json"
#: Characters whose boundaries are found at once; cached pieces of a task; bytes of the longest piece that is merged beside
#: others; leaves of the trees that are merged at once.
CHARS, CACHE, LONGEST, SIDE_BY_SIDE = 1_000_000, 300_000, 64, 1 << 18
#: A leaf holds rank * WIDE + place; NONE where no merge is possible.
WIDE, NONE = 1 << 40, 1 << 80


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary: itself where it prints, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def merge_all(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Ids after all merges; pairs maps two ids to (rank, id of both). Lowest rank first, leftmost first among equals.

    Symbols form a linked list over their first places; tree[1] is the least leaf.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * size)
    get = pairs.get
    for i in range(n - 1):
        if found := get((symbols[i], symbols[i + 1])):
            tree[size + i] = found[0] * WIDE + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(place: int, value: int) -> None:
        i = size + place
        if tree[i] == value:
            return
        tree[i] = value
        while i > 1:
            other = tree[i ^ 1]
            i >>= 1
            if other < value:
                value = other
            if tree[i] == value:  # nothing changes further up
                return
            tree[i] = value

    ids, after, before = symbols[:], list(range(1, n + 1)), list(range(-1, n - 1))
    while (root := tree[1]) < NONE:
        i = root % WIDE
        j = after[i]
        ids[i] = get((ids[i], ids[j]))[1]
        k = after[i] = after[j]
        ids[j] = -1
        put(j, NONE)
        if k < n:
            before[k] = i
            found = get((ids[i], ids[k]))
            put(i, found[0] * WIDE + i if found else NONE)
        else:
            put(i, NONE)
        if (h := before[i]) >= 0:
            found = get((ids[h], ids[i]))
            put(h, found[0] * WIDE + h if found else NONE)
    return [x for x in ids if x >= 0]


class Pairs:
    """Ranks of pairs of ids and what they become, for arrays of pairs."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        keys = np.array([a << 32 | b for a, b in pairs] or [0], np.int64)
        ranks = np.array([r for r, _ in pairs.values()] or [0], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], ranks[order]
        self.becomes = np.zeros(int(ranks.max()) + 1, np.int64)
        self.becomes[ranks] = [i for _, i in pairs.values()] or [0]
        self.empty = not pairs

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for pairs that do not merge and for ids under 0."""
        key = a << 32 | np.maximum(b, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        fine = (self.keys[at] == key) & (a >= 0) & (b >= 0) & (not self.empty)
        return np.where(fine, self.ranks[at], -1)


def merge_rows(ids: np.ndarray, pairs: Pairs) -> np.ndarray:
    """merge_all() of many pieces at once: rows of ids, a power of two wide, -1 behind the end; what went is -1 after it."""
    n, size = ids.shape
    bits, none = max(1, (size - 1).bit_length()), np.iinfo(np.int64).max
    leaf = lambda rank, place: np.where(rank < 0, none, rank << bits | place)
    ids = np.concatenate([ids, np.full((n, 1), -1, np.int64)], 1)  # behind the last place nothing merges
    after = np.tile(np.minimum(np.arange(1, size + 2), size), (n, 1))
    before = np.tile(np.arange(-1, size), (n, 1))
    tree = np.full((n, 2 * size), none, np.int64)
    tree[:, size:] = leaf(pairs.rank(ids[:, :size], ids[:, 1:]), np.arange(size)[None])
    width = size // 2
    while width:
        tree[:, width : 2 * width] = np.minimum(tree[:, 2 * width : 4 * width : 2], tree[:, 2 * width + 1 : 4 * width : 2])
        width //= 2
    row = np.flatnonzero(tree[:, 1] < none)
    while len(row):
        root = tree[row, 1]
        i = root & ((1 << bits) - 1)
        j = after[row, i]
        k = after[row, j]
        new = pairs.becomes[root >> bits]
        ids[row, i], ids[row, j] = new, -1
        after[row, i], before[row, k] = k, i
        h = before[row, i]
        has = np.flatnonzero(h >= 0)
        first, place = row[has], h[has]
        tree[row, size + j] = none
        tree[row, size + i] = leaf(pairs.rank(new, ids[row, k]), i)
        tree[first, size + place] = leaf(pairs.rank(ids[first, place], new[has]), place)
        for r, p in ((row, j), (row, i), (first, place)):
            p = (size + p) >> 1
            for _ in range(bits if size > 1 else 0):
                tree[r, p] = np.minimum(tree[r, 2 * p], tree[r, 2 * p + 1])
                p = p >> 1
        row = row[tree[row, 1] < none]
    return ids[:, :size]


class Codec(dict):
    """Vocabulary and merges of a tokenizers file; as a dict it is the cache from pieces of text to their ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        ids = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.pairs = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in reversed(list(enumerate(merges)))}
        self.table = Pairs(self.pairs)
        self.first = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.first[b] = ids[letter]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.bytes_of = {i: bytes(letters[c] for c in word) for word, i in ids.items()} | {i: t.encode() for t, i in self.added.items()}

    def learn(self, pieces: list[str]) -> None:
        """Merges pieces that are not in the cache."""
        coded = [p.encode("utf-8", "surrogatepass") for p in pieces]
        lengths = np.array([len(c) for c in coded], np.int64)
        wide = np.where(lengths > 1, 1 << np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64), 1)
        for at in np.flatnonzero(wide > LONGEST).tolist():
            self[pieces[at]] = merge_all(self.first[np.frombuffer(coded[at], np.uint8)].tolist(), self.pairs)
        for size in np.unique(wide[wide <= LONGEST]).tolist():
            group = np.flatnonzero(wide == size)
            for low in range(0, len(group), SIDE_BY_SIDE // size):
                some = group[low : low + SIDE_BY_SIDE // size]
                n = lengths[some]
                flat = np.frombuffer(b"".join(coded[k] for k in some.tolist()), np.uint8)
                ids = np.full((len(some), size), -1, np.int64)
                ids[np.arange(size)[None] < n[:, None]] = self.first[flat]
                ids = merge_rows(ids, self.table)
                left = ids >= 0
                whole, ends = ids[left].tolist(), np.cumsum(left.sum(1)).tolist()
                for k, a, b in zip(some.tolist(), [0, *ends], ends, strict=False):
                    self[pieces[k]] = whole[a:b]

    def split(self, text: str) -> list[str]:
        """Stretches of text and, at odd places, added tokens."""
        return self.cut.split(text) if self.cut else [text]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the cache is given back when it is full, and long pieces at once."""
        parts = [self.split(t) for t in texts]
        starts = iter(batch_starts([p for x in parts for p in x[::2]]))
        pieces: list[list[str]] = []
        for x in parts:
            for part in x[::2]:
                cut = [*next(starts).tolist(), len(part)]
                pieces.append(list(map(part.__getitem__, map(slice, cut, cut[1:]))))
        self.learn([p for p in set(chain.from_iterable(pieces)) if p not in self])
        stretch, out = iter(pieces), []
        for x in parts:
            ids: list[int] = []
            for k, part in enumerate(x):
                if k % 2:
                    ids.append(self.added[part])
                else:
                    ids += chain.from_iterable(map(self.__getitem__, next(stretch)))
            out.append(np.array(ids, np.int32))
        if len(self) > CACHE or any(len(t) > CHARS for t in texts):
            self.clear()
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One per Python worker; reused between tasks."""
    return Codec(path)


def encoded(texts: list, path: str) -> list[np.ndarray]:
    """Ids of each text (null: none), about CHARS characters at a time; a longer text is taken whole."""
    texts, ids, at = [t or "" for t in texts], [], 0
    while at < len(texts):
        to, chars = at, 0
        while to < len(texts) and (to == at or chars + len(texts[to]) < CHARS):
            chars += len(texts[to])
            to += 1
        ids += codec(path).encode(texts[at:to])
        at = to
    return ids


def decoded(ids: np.ndarray, path: str) -> str:
    """Text of ids; bytes that are no UTF-8 become replacement characters, as in the library."""
    return codec(path).decode_bytes(ids).decode("utf-8", "replace")


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per input row: id_col, token_ids array<int>, token_starts array<int> (byte offset of each id).

    A null text counts as empty and gives empty arrays. Strings of added tokens in a text become their ids. Other columns
    are ignored, so their names cannot clash; repeated rows give repeated rows. Texts of any length are encoded whole.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def ints(lists: list[np.ndarray]) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *lists])))

    def run(keys: list, texts: list) -> tuple:
        where = path or vocabulary(FILE)
        ids, piece = encoded(texts, where), codec(where).bytes_of
        sizes = [np.array([len(piece[i]) for i in x.tolist()], np.int32) for x in ids]
        return keys, ints(ids), ints([(np.cumsum(s) - s).astype(np.int32) for s in sizes])

    return map_rows(df, run, f"{id_col} {kind}, token_ids array<int>, token_starts array<int>", id_col, text_col, after=lambda: codec(path or vocabulary(FILE)).clear())


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", path: str | None = None) -> DataFrame:
    """One row per input row: id_col, text. Null ids count as none; an id outside the vocabulary raises."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(keys: list, ids) -> tuple:
        rows = [ids[k].values.to_numpy() if ids[k].is_valid else np.zeros(0, np.int32) for k in range(len(ids))]
        return keys, [decoded(x, path or vocabulary(FILE)) for x in rows]

    return map_rows(df, run, f"{id_col} {kind}, text string", id_col, ids_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id_col, n_tokens, ids_sha256 and decoded_sha256 of every row: encoded, decoded again, and digested in one pass.

    A null text counts as empty; ids may be null or repeat, rows that repeat give repeated rows; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(keys: list, texts: list) -> tuple:
        where = path or vocabulary(FILE)
        ids = encoded(texts, where)
        return keys, [len(x) for x in ids], [sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], [sha256(decoded(x, where).encode()).hexdigest() for x in ids]

    return map_rows(docs, run, f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", id_col, text_col, after=lambda: codec(path or vocabulary(FILE)).clear())


def op12_segment_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
