import html
import re
import time

import duckdb
import numpy as np
from pyspark.sql import functions as F

from smishlake.llm import cross_polytope, cube_mix, graphs, jaccard_join, reply_trees, site_templates
from tests.helpers import assert_same, connect


def components_of(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_jaccard(texts):
    sets = {i: set(jaccard_join.shingles(t).tolist()) for i, t in texts.items()}
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in components_of(pairs, ids).items()}


def corpus(rng, n):
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words, 60))
    base = [" ".join(rng.choice(words, rng.integers(4, 120))) for _ in range(8)]
    texts = {}
    for i in range(n):
        t = base[rng.integers(0, len(base))].split()
        for _ in range(rng.integers(0, 6)):
            t[rng.integers(0, len(t))] = str(rng.choice(words))
        text = " ".join(t)
        texts[i] = f"{passage} {text}" if rng.random() < 0.4 else text
    return texts


def test_jaccard_join_same_as_brute_force(spark, data, monkeypatch):
    assert_same(jaccard_join.op2_jaccard_join(spark, data), connect(data), jaccard_join.ORACLE)
    texts = corpus(np.random.default_rng(3), 150) | {1000: None, 1001: "", 1002: "  \n", 1003: "One two", 1004: "one TWO", 1005: "a " * 3000}
    df = spark.createDataFrame([(i, t, 5) for i, t in texts.items()], "doc_id long, text string, n int")
    want = brute_jaccard(texts)
    for pairs in (12, 2):  # with few pairs allowed, most tokens are frequent and combinations do the work
        monkeypatch.setattr(jaccard_join, "PAIRS", pairs)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(df).collect()}
        assert got == want
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0


def test_joins_take_odd_rows(spark):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (2, "ONE two three four five six"), (3, None), (3, None), (None, "one two three four five six"), (4, "x " * 60_000)]
    df = spark.createDataFrame([(i, t, 1, "f", 2, 3, [1]) for i, t in rows], "doc_id long, text string, id int, fam string, h int, n int, head array<int>")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (3, 0, 3), (None, 2, 1), (4, 1, 4)], key=repr)
    v = [1.0, 2.0, 2.0, 0.5]
    rows = [(1, v, 0), (1, v, 0), (2, [2.0, 4.0, 4.0, 1.0], 0), (3, v, 1), (4, None, 0), (5, [], 0)]
    df = spark.createDataFrame([(*r, 9, [7], 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, rep int, codes array<int>, weight int, k1 string")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in cross_polytope.near_duplicates(df).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5)]


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(15)
    sets, n = [], []
    for _ in range(120):
        x = rng.integers(-(1 << 62), 1 << 62, int(rng.integers(1, 900)))
        y = x.copy()
        k = int(len(x) * rng.choice([0, 0.05, 0.1, 0.11, 0.2, 0.5]))
        y[:k] = rng.integers(-(1 << 62), 1 << 62, k)
        if rng.random() < 0.5:
            y = np.concatenate([y, rng.integers(-(1 << 62), 1 << 62, len(x) // 8)])
        sets += [np.unique(x), np.unique(y)]
    n = np.array([len(s) for s in sets])
    i, j = np.arange(0, len(sets), 2), np.arange(1, len(sets), 2)
    may = jaccard_join.may_link(i, j, n, [jaccard_join.sketch_of(s) for s in sets])
    for a, b, ok in zip(i, j, may, strict=True):
        shared = len(np.intersect1d(sets[a], sets[b]))
        assert ok or 100 * shared < 80 * (n[a] + n[b] - shared)
    assert not may.all()


def test_extension_keeps_every_link():
    rng = np.random.default_rng(4)
    for n in (2, 4, 5, 9, 30, 159, 161, 700):
        for _ in range(20):
            x = np.sort(rng.choice(1 << 40, n, replace=False)).astype(np.int64)
            y = x.copy()
            change = rng.choice(n, int(n / 9), replace=False)
            y[change] = rng.integers(1 << 41, 1 << 42, len(change))
            y = np.unique(y)
            shared = len(np.intersect1d(x, y))
            if 9 * shared < 4 * (len(x) + len(y)) or (x == y).all() if len(x) == len(y) else False:
                continue
            often = np.sort(rng.choice(np.union1d(x, y), int(rng.choice([0, n // 2, n])), replace=False))
            index = []
            for s in (x, y):
                more, combos = jaccard_join.extension(s, often)
                head = s[: jaccard_join.prefix_size(len(s))]
                index.append((set(head[~np.isin(head, often)].tolist()) | set(more.tolist()), set(combos.tolist())))
            assert index[0][0] & index[1][0] or index[0][1] & index[1][1]


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1200)]
    got = {r["node"]: r["component"] for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components_of(edges, {x for e in edges for x in e})
    assert got == {k: v for k, v in want.items() if k in got} and set(got) == {x for e in edges if e[0] != e[1] for x in e}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cross_polytope(spark, data, monkeypatch):
    assert_same(cross_polytope.op3_cross_polytope(spark, data), connect(data), cross_polytope.ORACLE)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(20, 64))
    rows = [(i, (base[i % 20] + rng.normal(size=64) * 0.12).tolist(), i % 2) for i in range(200)]
    rows += [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, rows[0][1], None), (904, rows[0][1], 0), (905, [None] * 64, 0), (906, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: y for i, _, y in rows}
    ids = sorted(unit)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if label[a] == label[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
    assert len(pairs) > 300
    links = {i: sum(i in p for p in pairs) for i in label}
    comp = components_of(pairs, label)
    monkeypatch.setattr(cross_polytope, "BLOCK", 8)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in cross_polytope.near_duplicates(df).collect()}
    assert set(got) == set(label)
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(links.values()) and all(got[i][0] <= links[i] for i in links)
    assert got[901] == (0, 901, True) and got[903] == (0, 903, True) and np.mean([got[i][1] == comp[i] for i in label]) > 0.97
    assert cross_polytope.near_duplicates(df.limit(0)).count() == 0


def test_reply_trees(spark, data):
    assert_same(reply_trees.op5_reply_trees(spark, data), connect(data), reply_trees.ORACLE)
    # a tree with two branches, a lone root, a missing parent, a cycle
    rows = [("t", 1, None, "user", "hi", 0.0), ("t", 2, 1, "assistant", "low", 1.0), ("t", 3, 1, "assistant", "high \\ <|im_end|>", 5.0), ("t", 4, 3, "user", None, 1.0), ("u", 1, 99, None, "x", None), ("c", 1, 2, "user", "a", 0.0), ("c", 2, 1, "user", "b", 0.0)]
    m = spark.createDataFrame(rows, "tree_id string, msg_id long, parent_id long, role string, text string, score double")
    paths, jumps = reply_trees.branches(m)
    assert sorted((r["tree_id"], r["leaf_id"], r["score"], r["n"]) for r in paths.collect()) == [("t", 2, 1.0, 2), ("t", 4, 6.0, 3), ("u", 1, 0.0, 1)]
    both = reply_trees.format_paths(reply_trees.choose(paths, 2), jumps, m).withColumn("turns", reply_trees.read_back(F.col("formatted")))
    got = {(r["tree_id"], r["branch"]): [(t["role"], t["text"]) for t in r["turns"]] for r in both.collect()}
    assert got[("t", 1)] == [("user", "hi"), ("assistant", "high \\ <|im_end|>"), ("user", "")] and got[("t", 2)][1] == ("assistant", "low") and got[("u", 1)] == [("", "x")]
    for r in both.withColumn("said", reply_trees.masked(F.col("segments"))).collect():  # the mask covers the assistants' texts of the path, no more
        assert r["formatted"] == "".join(x["text"] for x in r["segments"])
        assert r["said"] == "".join(t["text"] for t in r["turns"] if t["role"] == "assistant")
        assert all(x["loss"] == (i % 3 == 1 and r["turns"][i // 3]["role"] == "assistant") for i, x in enumerate(r["segments"]))
    chain = spark.createDataFrame([(1, i, "user", f"m{i}") for i in range(70)], "conv_id long, turn long, role string, text string")
    lin = reply_trees.linear(chain)
    paths, jumps = reply_trees.branches(lin)
    assert reply_trees.digests(reply_trees.format_paths(reply_trees.choose(paths), jumps, lin)).first()["n_turns"] == 70
    paths, jumps = reply_trees.branches(m.limit(0))
    assert reply_trees.format_paths(reply_trees.choose(paths), jumps, m.limit(0)).count() == 0


def test_reply_trees_ties_and_names(spark, tmp_path):
    # equal scores: the longer branch, then the smaller leaf; ids that are null or repeat; columns of the code's own names
    rows = [(1, 1, None, 0.0), (1, 2, 1, 2.0), (1, 3, 1, 1.0), (1, 4, 3, 1.0), (2, 1, None, None), (2, 2, 1, 1.0), (2, 3, 1, 1.0)]
    m = spark.createDataFrame([(t, i, p, "user", f"{t}.{i}", s) for t, i, p, s in rows], "tree_id long, msg_id long, parent_id long, role string, text string, score double")
    paths, jumps = reply_trees.branches(m)
    assert sorted((r["tree_id"], r["leaf_id"]) for r in reply_trees.choose(paths).collect()) == [(1, 4), (2, 2)]
    assert sorted((r["tree_id"], r["branch"], r["leaf_id"]) for r in reply_trees.choose(paths, 2).collect()) == [(1, 1, 4), (1, 2, 2), (2, 1, 2), (2, 2, 3)]
    odd = [(1, None, "assistant", "a", 9, 9), (1, None, "assistant", "a", 9, 9), (1, 3, None, None, 9, 9), (2, 0, "assistant", "x" * 100_000, 9, 9)]
    spark.createDataFrame(odd, "conv_id long, turn long, role string, text string, msg_id int, tree_id int").write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r["conv_id"]: r for r in reply_trees.op5_reply_trees(spark, str(tmp_path)).collect()}
    assert (out[1]["n_turns"], out[1]["loss_chars"], out[2]["loss_chars"], out[-1]["n_turns"]) == (3, 2, 100_000, 2)


def test_reply_trees_without_conv_id(spark, tmp_path):
    rows = [(None, 0, "user", "one"), (None, 1, "assistant", "two <|im_end|>"), (None, 1, "assistant", "two <|im_end|>"), (None, 2, None, None), (7, 0, "user", "x"), (7, 1, "assistant", "y")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = reply_trees.op5_reply_trees(spark, str(tmp_path)).collect()
    want = con.execute(reply_trees.ORACLE).fetchall()
    assert len(got) == 3 and sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_cube_mix(spark, data):
    out = cube_mix.op8_cube_mix(spark, data)
    rows = out.collect()
    assert rows == cube_mix.op8_cube_mix(spark, data).collect() or sorted(rows) == sorted(cube_mix.op8_cube_mix(spark, data).collect())
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    src = out.join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max("size").alias("m"), F.max("source_size").alias("s")).collect()
    assert all(abs(r["t"] - r["g"]) <= max(0.02 * r["g"], r["m"]) for r in src) and all(r["g"] <= 2 * r["s"] + 1e-6 for r in src)
    assert abs(sum(r["g"] for r in src) - 1.5 * sum(r["s"] for r in src)) < 1e-3
    rng = np.random.default_rng(7)
    pi, x = rng.random(500), rng.integers(1, 900, 500).astype(float)
    done = cube_mix.fly(pi.copy(), x, rng.random(50))
    assert ((done > 0) & (done < 1)).sum() <= 2 and abs(done.sum() - pi.sum()) < 1e-6 and abs((done * x).sum() - (pi * x).sum()) < 1e-3
    odd = spark.createDataFrame([(1, None, "a"), (2, "", None), (3, "x y", None), (3, "x y", None), (4, "z", "b")], "doc_id long, text string, source string")
    assert cube_mix.mix(odd).count() == 5 and cube_mix.mix(odd.limit(0)).count() == 0


def test_targets_same_as_iterated_reshare(spark):
    rng = np.random.default_rng(11)
    for n in (1, 2, 5, 9):
        sizes = {(None if i == n - 1 and n > 2 else f"s{i}"): int(rng.integers(0, 3) * rng.integers(1, 5000)) for i in range(n)}
        names = sorted(sizes, key=lambda x: (x is None, x or ""))
        weight = {k: cube_mix.WEIGHTS[i % 3] for i, k in enumerate(names)}
        left, full = 1.5 * sum(sizes.values()), {}
        while True:  # share by weight, stop who is above, deal the rest again
            open_ = [k for k in names if k not in full]
            share = {k: left * weight[k] / sum(weight[j] for j in open_) for k in open_}
            over = [k for k in open_ if share[k] > 2 * sizes[k]]
            if not over:
                break
            for k in over:
                full[k] = 2.0 * sizes[k]
                left -= full[k]
        want = {**share, **full}
        got = {r["source"]: r["target"] for r in cube_mix.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert all(abs(got[k] - want[k]) < 1e-6 * max(1.0, want[k]) for k in names), (sizes, got, want)


def test_taken_near_the_best_choice(spark):
    rng = np.random.default_rng(12)
    rows = [(s * 100 + i, " ".join(["w"] * int(rng.integers(1, 40))), f"s{s}") for s in range(4) for i in range(9)] + [(900, " ".join(["w"] * 30_000), "s4"), (901, "w", "s4")]
    out = cube_mix.mix(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, copies int, target string")).collect()
    for s in {r["source"] for r in out}:
        mine = [r for r in out if r["source"] == s]
        sizes, target = [r["size"] for r in mine], mine[0]["target"]
        reach = {0}
        for x in sizes:  # all totals that 0, 1 or 2 copies of each document can give
            reach |= {t + x for t in reach} | {t + 2 * x for t in reach}
        taken = sum(r["taken"] for r in mine)
        assert taken in reach and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in mine)
        if s != "s4":
            assert abs(taken - target) <= min(abs(t - target) for t in reach) + max(sizes)


ARTICLE = "<article><h1>Head {i}</h1><p>Text &amp; more {i}<p>Second <b>bold</b><div class='ad'>buy</div><ul><li>one<li>two</ul></article>"
PAGE = "<html><head><title>t</title><script>var t='</p>';</script></head><body><nav><ul><li>menu</ul></nav><div>promo box</div>" + ARTICLE + "<div id=comments>first!</div><footer>f</footer></body></html>"


def test_site_templates(spark, data):
    root = site_templates.parse(PAGE.format(i=1))
    site_templates.measure(root)
    assert site_templates.main_text(root) == "Head 1\nText & more 1\nSecond bold\none\ntwo"
    bare = "<body><div>promo box</div><h1>T {i}</h1><p>body text {i}</p><div>same footer line</div></body>"
    pages = [(i, f"http://a.example/{i}", bare.format(i=i)) for i in range(8)] + [(90, None, None), (91, "http://b.example/", ""), (92, "http://b.example/x", "plain"), (92, "http://b.example/x", "plain")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in site_templates.extract(df).collect()}
    assert got[3] == "T 3\nbody text 3" and got[90] == "" and got[91] == "" and got[92] == "plain"
    assert site_templates.extract(df).count() == len(pages) and site_templates.extract(df.limit(0)).count() == 0
    for r, p in zip(site_templates.op10_site_templates(spark, data).orderBy("page_id").collect(), spark.read.parquet(f"{data}/pages.parquet").orderBy("page_id").collect(), strict=True):
        body = re.search(r"(?s)<article>(.*?)(?:</article>|<footer>|$)", p["html"])[1].replace("<br>", " ")
        want = "\n".join(y for y in (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", body)) if y)
        assert r["text"] == want and r["n_chars"] == len(want)


def test_site_templates_of_large_hosts(spark):
    # boxes in turn: each stands on 6 of 240 pages, without a telling class
    page = "<body><article><h1>T {i}</h1><p>body text {i}</p><div>offer number {k}</div><div>only here {i}</div></article></body>"
    rows = [(i, f"http://a.example/{i}", page.format(i=i, k=i % 40)) for i in range(240)]
    rows += [(1000 + i, f"http://b.example/{i}", page.format(i=i, k=0)) for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in site_templates.extract(df).collect()}
    assert all(got[i] == f"T {i}\nbody text {i}\nonly here {i}" for i in range(240))
    assert got[1001] == "T 1\nbody text 1\noffer number 0\nonly here 1"


def test_templates_decide_where_tags_do_not(spark, data):
    """The given pages with all telling tags and classes taken away: plain boxes with random class names, one menu, side
    box and footer per host. Only counting can tell them from the article."""
    rng = np.random.default_rng(9)
    host = lambda u: site_templates.host_of(u)
    boxes = {}
    rows, want = [], {}
    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        h = host(r["url"])
        if h not in boxes:
            boxes[h] = [f'<div class="{"".join(rng.choice(list("qxzjkvw"), 9))}"><p>{kind} of {h}</p><div>more of it</div></div>' for kind in ("menu", "side box", "footer")]
        body = re.search(r"(?s)<article>(.*?)(?:</article>|<footer>|$)", r["html"])[1]
        menu, side, footer = boxes[h]
        rows.append((r["page_id"], r["url"], f'<html><body>{menu}<div class="jq{r["page_id"]}zx">{body}</div>{side}{footer}</body></html>'))
        text = body.replace("<br>", " ")
        want[r["page_id"]] = "\n".join(y for y in (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", text)) if y)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    copies = {}
    for i, u, p in rows:
        copies.setdefault(host(u), set()).add(p)
    large = {h for h, p in copies.items() if len(p) >= site_templates.LEAST_PAGES}
    assert large
    got = {r["page_id"]: r["text"] for r in site_templates.extract(df).collect()}
    for i, u, p in rows:
        off = site_templates.parse(p)
        site_templates.measure(off)
        plain = site_templates.main_text(off)
        assert plain != want[i] and f"menu of {host(u)}" in plain
        assert got[i] == (want[i] if host(u) in large else plain)


def text_of(page):
    root = site_templates.parse(page)
    site_templates.measure(root)
    return site_templates.main_text(root)


def test_html_cases(spark):
    assert text_of("<main><article>One</article><p>between</p><article>Two longer</article></main>") == "One\nTwo longer"
    assert text_of("<main><h1>T</h1><nav>n</nav><p>a</p></main><p>b") == "T\na"
    assert text_of("İ" * 20 + "<script>x</script>kept words") == "İ" * 20 + "kept words"
    assert text_of("<p title=it's>one</p><p class='a>b'>two</p><p>3 < 4 and 5 > 2</p>") == "one\ntwo\n3 < 4 and 5 > 2"
    assert text_of("<p>open <b") == "open <b" and text_of('<p>quote <a href="x>y</a> end') == 'quote y end'
    assert text_of("<table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li>e</ul>") == "a\nb\nc\nd\ne"
    assert text_of("<b>x<p>y</b>z</p><i>w") == "x\nyz\nw" and text_of("") == "" and text_of("<") == "<"
    for page in ("<div>" * 30_000 + "deep" + "</div>" * 30_000, "<b>" * 30_000 + "x" + "</i>" * 30_000, "<a href='" * 30_000, "<x \"" * 30_000, "<!--" * 30_000, "<p>q" * 30_000, "<b><p>" * 20_000 + "</b>" * 20_000):
        began = time.time()
        text_of(page)
        assert time.time() - began < 5
    rows = [(1, "http://a/1", "<article>x</article>", "c", ["d"])] * 2 + [(None, "http://a/1", None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _page_key string, hashes array<string>")
    assert sorted((r["page_id"] or 0, r["text"]) for r in site_templates.extract(df).collect()) == [(0, ""), (1, "x"), (1, "x")]
