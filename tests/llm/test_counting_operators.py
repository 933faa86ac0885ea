"""Operators 11 to 13: phrase collocations, segment-tree BPE, vector codes."""

import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from smishlake.llm import collocations, member_lloyd, segment_bpe
from tests.helpers import assert_same, connect


# ---- phrases -----------------------------------------------------------------------------------------------------------
def counted(rows, k):
    out = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").encode().lower().decode()):
            words = re.findall(r"[^\x20\x09]+", piece)
            for i in range(len(words) - k + 1):
                out["und" if lang is None else lang, tuple(words[i : i + k])] += 1
    return out


def brute_collocations(rows, least, share, top, longest=5):
    f = Counter()
    for k in range(1, longest + 1):
        f.update(counted(rows, k))
    n = Counter()
    for (lang, w), c in counted(rows, 1).items():
        n[lang] += c
    cand = {x: c for x, c in f.items() if len(x[1]) > 1 and c >= least}
    out = defaultdict(list)
    for (lang, w), a in cand.items():
        if any(la == lang and len(v) > len(w) and share * a <= 100 * c and any(v[i : i + len(w)] == w for i in range(len(v))) for (la, v), c in cand.items()):
            continue
        score, cut = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:cut]], f[lang, w[cut:]]))
    return {(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, found in out.items() for i, x in enumerate(sorted(found)[:top])}


def test_collocations_same_as_sql_and_brute_force(spark, data, monkeypatch):
    assert_same(collocations.op11_collocations(spark, data), connect(data), collocations.ORACLE)
    rng = np.random.default_rng(4)
    words = ["The", "of", "ox", "é", "x\x00y", "ÄB", "'tis", "a-b", "of"]
    rows = [(["en", "de", None, ""][rng.integers(0, 4)], "".join(str(rng.choice(words)) + str(rng.choice([" ", " ", "\t", "  ", ". ", "\n"])) for _ in range(rng.integers(0, 60)))) for _ in range(120)]
    rows += [("en", None), (None, ""), ("en", " . ,"), ("und", "of ox of ox of ox"), ("en", "the of " * 3000)] + [("de", "the of ox é")] * 9
    df = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], "lang string, text string, n int, phrase string, k int")
    for full, burst, bits in ((600_000, 4096, 1 << 30), (60, 8, 64)):  # small tries burst and spill; a small sieve lets too much through
        monkeypatch.setattr(collocations, "FULL", full)
        monkeypatch.setattr(collocations, "MOST_BITS", bits)
        monkeypatch.setattr(collocations.HatTrie.__init__, "__defaults__", (burst,))
        monkeypatch.setattr(collocations, "TEXT", 500)
        got = {tuple(r) for r in collocations.collocations(df, least=6, share=90, top=40).collect()}
        assert got == brute_collocations(rows, 6, 90, 40)
    assert collocations.collocations(df.limit(0)).count() == 0


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.integers(0, 6), min_size=3, max_size=3), max_size=200), st.integers(1, 5), st.integers(0, 40))
def test_trie_counts_and_spills(rows, burst, keep):
    trie, got = collocations.HatTrie(3, burst), Counter()
    for i, r in enumerate(rows):
        one = np.unique(np.array([r, [0, 1, i % 3]], np.int64), axis=0)
        trie.add(one, np.full(len(one), 2))
        if i % 50 == 49:
            ids, n = trie.spill(keep)
            got.update({tuple(x): c for x, c in zip(ids.tolist(), n.tolist(), strict=True)})
            assert trie.size <= max(keep, 0) and trie.size == trie._weight(trie.root)
    ids, n = trie.spill(0)
    for x, c in zip(ids.tolist(), n.tolist(), strict=True):
        got[tuple(x)] += c
    want = Counter()
    for i, r in enumerate(rows):
        want.update(dict.fromkeys({tuple(r), (0, 1, i % 3)}, 2))
    assert trie.size == 0 and got == want


def test_sieve_has_every_frequent_word():
    words = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64)
    for bits in (64, 1 << 12):
        at = collocations.window_hashes(words[:200], 1) & np.uint64(bits - 1)
        sieve = np.zeros(bits // 64, np.uint64)
        np.bitwise_or.at(sieve, (at >> np.uint64(6)).astype(int), np.uint64(1) << (at & np.uint64(63)))
        each = collocations.may_be(sieve, collocations.window_hashes(words, 1))
        assert each[:200].all() and each.tolist() == [collocations.word_may_be(sieve, int(w)) for w in words]


# ---- byte pairs --------------------------------------------------------------------------------------------------------
PATH = public_tokenizers.path("byte_bpe_50k.json")


def library():
    return Tokenizer.from_file(PATH)


def test_segment_bpe_same_as_the_library(spark, data):
    t = library()
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in segment_bpe.op12_segment_bpe(spark, data).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = t.encode(text, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_segment_bpe_takes_odd_rows(spark):
    t = library()
    texts = [None, "", " ", "x <|endoftext|>  y<|endoftext|><|endoftext", "a" * 70_000, "\U00010d4a1\U00011bf1 ا́ 　　z", "é\x00\x85 'll's'S"]
    df = spark.createDataFrame([(i % 3 if i else None, x, [1], "k") for i, x in enumerate(texts + texts)], "doc_id long, text string, token_ids array<int>, piece string")
    rows = segment_bpe.encode(df)
    back = segment_bpe.decode(rows.withColumnRenamed("token_ids", "ids"), ids_col="ids").collect()
    assert sorted(r["text"] for r in back) == sorted(x or "" for x in texts + texts)
    want = sorted(t.encode(x or "", add_special_tokens=False).ids for x in texts + texts)
    got = rows.collect()
    assert sorted(r["token_ids"] for r in got) == want
    spans = [r for r in got if len(r["token_ids"]) > 1]
    assert all(r["token_starts"][0] == 0 and r["token_starts"] == sorted(r["token_starts"]) for r in spans)
    assert segment_bpe.digests(df.limit(0)).count() == 0


@settings(deadline=None, max_examples=150)
@given(st.lists(st.integers(0, 4), max_size=40), st.dictionaries(st.tuples(st.integers(0, 8), st.integers(0, 8)), st.integers(0, 20), max_size=12))
def test_segment_tree_merges_as_a_scan_does(symbols, ranks):
    pairs = {p: (r * 100 + i, 5 + i) for i, (p, r) in enumerate(ranks.items())}
    want = list(symbols)
    while True:
        best = min(((pairs[p][0], i) for i, p in enumerate(zip(want, want[1:], strict=False)) if p in pairs), default=None)
        if best is None:
            break
        want[best[1] : best[1] + 2] = [pairs[want[best[1]], want[best[1] + 1]][1]]
    assert segment_bpe.merge_all(symbols, pairs) == want


def test_broken_bytes_decode_as_in_the_library():
    t, rng = library(), np.random.default_rng(2)
    for _ in range(300):
        ids = rng.integers(0, 50257, rng.integers(0, 9)).astype(np.int32)
        assert segment_bpe.decoded(ids, PATH) == t.decode(ids.tolist(), skip_special_tokens=False)


# ---- vector codes ------------------------------------------------------------------------------------------------------
def brute_codes(rows, parts, entries, rounds):
    """rows(id, vector, label) in plain Python."""
    fine = [(i, [int(np.clip(np.floor(256 * x), -(1 << 26), 1 << 26)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in fine) // parts)
    fine = [(i, v + [0] * (parts * width - len(v)), label) for i, v, label in fine]
    first = sorted(fine, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    best = lambda p, v: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            at = [best(p, v)[1] for _, v, _ in fine]
            book = []
            for k, e in enumerate(books[p]):
                mine = [cut(v, p) for (_, v, _), j in zip(fine, at, strict=True) if j == k]
                book.append([sum(c) // len(mine) for c in zip(*mine, strict=True)] if mine else e)
            new.append(book)
        books = new
    digest = sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, total = [], Counter()
    for i, v, label in fine:
        found = [best(p, v) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
        total[label] += out[-1][2]
    return sorted(((i, c, e, total[label], digest) for i, c, e, label in out), key=repr)


def test_member_lloyd_same_as_sql_and_brute_force(spark, data, monkeypatch):
    assert_same(member_lloyd.op13_member_lloyd(spark, data), connect(data), member_lloyd.ORACLE)
    rng = np.random.default_rng(6)
    rows = [(int(i), rng.normal(size=6).round(2).tolist(), int(rng.integers(0, 3)) if rng.random() < 0.8 else None) for i in rng.permutation(70)]
    rows += [(3, [0.5] * 6, 1), (3, [0.5] * 6, 1), (None, [1.0] * 6, 1), (90, None, 1), (91, [1.0, None, 0.0, 0.0, 0.0, 0.0], 2), (92, [float("nan")] * 6, 0), (93, [float("inf")] * 6, 0), (94, [2.0, -1e300], 1), (95, [], None), (96, [0.0] * 5, None)]
    df = spark.createDataFrame([(*r, 1, 2, [0]) for r in rows], "vec_id long, embedding array<double>, label int, row int, pos int, part array<int>")
    for owned, rounds in ((4096, 2), (8, 4)):
        monkeypatch.setattr(member_lloyd, "OWNED", owned)
        got = sorted((tuple(r) for r in member_lloyd.compress(df, parts=2, entries=9, rounds=rounds).collect()), key=repr)
        assert got == brute_codes(rows, 2, 9, rounds)
    assert member_lloyd.compress(df.limit(0)).count() == 0
    assert [len(r["code"]) for r in member_lloyd.compress(df.filter("vec_id = 3")).collect()] == [32] * sum(r[0] == 3 for r in rows)


def test_large_components_are_exact():
    rng = np.random.default_rng(8)
    x, book = rng.integers(-(1 << 26), 1 << 26, (50, 40)), rng.integers(-(1 << 26), 1 << 26, (7, 40))
    index, distance = member_lloyd.nearest(x, book)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book)) for v in x]
    assert list(zip(distance.tolist(), index.tolist(), strict=True)) == want
