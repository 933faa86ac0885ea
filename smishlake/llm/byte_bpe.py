"""Operator 9: byte-level BPE encoding and decoding without a regex.

Pre-tokenisation is a finite-state transducer over code-point classes. A batch of texts becomes one array of classes;
each class is a function from state to state, and because composing functions is associative, whole blocks are composed
side by side, the block functions are scanned by doubling, and the states inside the blocks follow from the block starts.
Token slices then go through pair merging with a cache of slices already merged. Token starts are kept so that a span of
ids can be decoded on its own.
"""

from __future__ import annotations

import base64
import unicodedata
from functools import lru_cache
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from smishlake.llm.common import map_rows, table

L, N, P, W_IN, SP_LAST, W_LAST, APOS1, APOS2, RESET = range(9)
IN_L, IN_N, IN_P, IN_W, SPACE, EAT1, EAT2, FRESH = range(8)
STATES, BLOCK, CACHE = 8, 64, 200_000
#: White_Space of the Unicode standard (fixed values).
SPACES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Letters and numbers that version 16 of the Unicode standard added, first and last of each range (fixed values): the
#: tokenizer libraries know them, unicodedata of Python 3.13 does not.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NUMBERS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point: letter, number, other, or (W_IN) white space."""
    out = np.full(0x110000, P, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = L
        elif k == "N":
            out[c] = N
    for ranges, k in ((LETTERS_16, L), (NUMBERS_16, N)):
        for first, last in ranges:
            out[first : last + 1] = k
    out[list(SPACES)] = W_IN
    return out


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and 'a token starts here' for each class and state."""
    nxt, start = np.zeros((9, STATES), np.uint8), np.ones((9, STATES), bool)
    for s in range(STATES):
        for cls, into in ((L, IN_L), (N, IN_N), (P, IN_P)):
            nxt[cls, s] = into
            start[cls, s] = s not in (into, SPACE)
        nxt[APOS1, s], nxt[APOS2, s] = (IN_P, IN_P) if s in (IN_P, SPACE) else (EAT1, EAT2)
        start[[APOS1, APOS2], s] = s not in (IN_P, SPACE)
        nxt[W_IN, s], start[W_IN, s] = IN_W, s != IN_W
        nxt[SP_LAST, s], nxt[W_LAST, s], nxt[RESET, s] = SPACE, FRESH, FRESH
    nxt[L, EAT1], nxt[L, EAT2] = FRESH, EAT1
    start[L, [EAT1, EAT2]] = False
    return nxt, start


NEXT, START = transitions()


def token_starts(text: str) -> np.ndarray:
    """Code-point offsets at which tokens start; NUL-free separators are the caller's: see batch_starts."""
    return batch_starts([text])[0]


def batch_starts(texts: list[str]) -> list[np.ndarray]:
    """Token starts of each text, found for all texts in one scan."""
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths + 1)
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = classes()[points]
    reset = ends - 1
    cls[reset] = RESET
    # white space: is the next thing in the same text a non-space?
    space = cls == W_IN
    before_word = np.zeros(len(cls), bool)
    before_word[:-1] = space[:-1] & ~space[1:] & (cls[1:] != RESET)
    # apostrophes that open a contraction
    low = np.concatenate([points, np.zeros(2, np.uint32)])
    low[reset] = 0
    apos = np.flatnonzero(low[:-2] == 39)
    one, two = low[apos + 1], low[apos + 2]
    cls[apos[np.isin(one, [115, 116, 109, 100])]] = APOS1
    pair = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
    cls[apos[pair]] = APOS2
    cls[before_word] = np.where(points[before_word] == 32, SP_LAST, W_LAST)

    n, blocks = len(cls), -(-len(cls) // BLOCK)
    grid = np.full(blocks * BLOCK, RESET, np.uint8)
    grid[:n] = cls
    columns = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    flat = NEXT.ravel()
    whole = np.tile(np.arange(STATES, dtype=np.uint8), (blocks, 1))
    for c in columns:
        whole = flat[c[:, None].astype(np.int16) * STATES + whole]
    step = 1
    while step < blocks:  # inclusive scan of the block functions by doubling
        later = np.take_along_axis(whole[step:], whole[:-step], axis=1)
        whole = np.concatenate([whole[:step], later])
        step *= 2
    state = np.concatenate([[FRESH], whole[:-1, FRESH]]).astype(np.uint8)
    starts = np.empty((BLOCK, blocks), bool)
    for j, c in enumerate(columns):
        at = c.astype(np.int16) * STATES + state
        starts[j], state = START.ravel()[at], flat[at]
    where = np.flatnonzero(starts.T.ravel()[:n] & (cls != RESET))
    cut = np.searchsorted(where, ends - 1)
    begin = np.concatenate([[0], cut[:-1]])
    return [where[a:b] - (e - 1 - k) for a, b, e, k in zip(begin, cut, ends, lengths, strict=True)]


class Merger:
    """Ranks of a vocabulary file and the ids of slices already merged: a full cache becomes the older one."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = {v: k for k, v in self.ranks.items()}
        self.cache: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) > 400:
            return self.merge_long(parts)
        none = 1 << 60
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            low = min(pairs)
            if low == none:
                break
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def merge_long(self, parts: list[bytes]) -> list[int]:
        """The same merges from a heap, for slices of many bytes."""
        import heapq

        ranks, n = self.ranks, len(parts)
        after, before, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or parts[i] + parts[j] != joined:
                continue
            parts[i], alive[j], after[i] = joined, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a] + parts[b]))
        return [ranks[p] for p, ok in zip(parts, alive, strict=True) if ok]

    def encode(self, text: str, starts: np.ndarray) -> list[int]:
        cache, ids = self.cache, []
        cut = [*starts.tolist(), len(text)]
        for a, b in zip(cut, cut[1:], strict=False):
            piece = text[a:b]
            got = cache.get(piece)
            if got is None:
                got = self.older.get(piece) or self.merge(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= 64:
                    if len(cache) >= CACHE:
                        self.older, self.cache = cache, {}
                        cache = self.cache
                    cache[piece] = got
            ids += got
        return ids


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    """One per Python worker; reused between tasks."""
    return Merger(path)


def forget(path: str) -> None:
    """Gives back the merges that a task has cached; the vocabulary stays."""
    m = merger(path)
    m.cache, m.older = {}, {}


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def piece_lengths(path: str) -> np.ndarray:
    m = merger(path)
    out = np.zeros(max(m.pieces) + 1, np.int32)
    for i, p in m.pieces.items():
        out[i] = len(p)
    return out


def encoded(texts: list, path: str) -> list[np.ndarray]:
    """Token ids of each text (null: none); boundaries are found for about a million characters at a time."""
    m, texts, ids, at = merger(path), [t or "" for t in texts], [], 0
    while at < len(texts):
        to, chars = at, 0
        while to < len(texts) and (to == at or chars + len(texts[to]) < 1_000_000):
            chars += len(texts[to])
            to += 1
        ids += [np.array(m.encode(t, s), np.int32) for t, s in zip(texts[at:to], batch_starts(texts[at:to]), strict=True)]
        at = to
    return ids


def decoded(ids: np.ndarray, path: str) -> bytes:
    return b"".join(map(merger(path).pieces.__getitem__, ids.tolist()))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per input row: id_col, token_ids array<int>, token_starts array<int> (byte offset of each id).

    A null text counts as empty and gives empty arrays. Other columns are ignored, so their names cannot clash; repeated
    rows give repeated rows. Texts of any length are encoded whole.
    """
    import pyarrow as pa

    kind = df.schema[id_col].dataType.simpleString()

    def ints(lists: list[np.ndarray]) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *lists])))

    def run(keys: list, texts: list) -> tuple:
        where = path or vocabulary()
        size = piece_lengths(where)
        ids = encoded(texts, where)
        return keys, ints(ids), ints([(np.cumsum(size[x]) - size[x]).astype(np.int32) for x in ids])

    return map_rows(df, run, f"{id_col} {kind}, token_ids array<int>, token_starts array<int>", id_col, text_col, after=lambda: forget(path or vocabulary()))


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", path: str | None = None) -> DataFrame:
    """One row per input row: id_col, n_tokens, ids_le binary (ids as little-endian uint32), decoded binary.

    Null ids count as none. An id outside the vocabulary raises.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(keys: list, ids) -> tuple:
        rows = [ids[k].values.to_numpy() if ids[k].is_valid else np.zeros(0, np.int32) for k in range(len(ids))]
        return keys, [len(x) for x in rows], [x.astype("<u4").tobytes() for x in rows], [decoded(x, path or vocabulary()) for x in rows]

    return map_rows(df, run, f"{id_col} {kind}, n_tokens bigint, ids_le binary, decoded binary", id_col, ids_col)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id_col, n_tokens, ids_sha256 and decoded_sha256 of every row: encoded, decoded again, and digested in one pass.

    A null text counts as empty; ids may be null or repeat, rows that repeat give repeated rows; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(keys: list, texts: list) -> tuple:
        where = path or vocabulary()
        ids = encoded(texts, where)
        return keys, [len(x) for x in ids], [sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], [sha256(decoded(x, where)).hexdigest() for x in ids]

    return map_rows(docs, run, f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", id_col, text_col, after=lambda: forget(path or vocabulary()))
