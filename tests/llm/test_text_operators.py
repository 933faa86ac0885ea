import base64
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from smishlake.llm import byte_bpe, host_rules, language_codes, license_scan, toxicity
from tests.helpers import assert_same, connect

SCHEMA = "doc_id long, text string, lang string, source string, host string, score double"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, "clash", 0.5) for i, t, lang, source in rows], SCHEMA)


ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "One two.", None, "b"), (4, "One two.", None, "b"), (5, "x" * 50_000, "en", "b"), (6, "a b " * 20_000, "en", "b")]


@pytest.fixture(scope="module")
def tokenizer():
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_same_as_reference_tokenizer(tokenizer):
    m = byte_bpe.merger(byte_bpe.vocabulary())
    rng = np.random.default_rng(1)
    letters = list("aZé1² ²  \n\t'''srtvemld!?.　\xa0́ñ中😀\x1c\x85\0")
    for _ in range(300):
        texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(5)]
        for t, s in zip(texts, byte_bpe.batch_starts(texts), strict=True):
            assert m.encode(t, s) == tokenizer.encode_ordinary(t), t
    for t in ("ab" * 3000, "é" * 5000, " " * 5000 + "q", "don't we'll I'd'll '''s"):
        assert m.encode(t, byte_bpe.token_starts(t)) == tokenizer.encode_ordinary(t)


def test_bpe_query(spark, data, tokenizer):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in byte_bpe.op9_byte_bpe(spark, data).collect():
        ids = tokenizer.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())
    both = byte_bpe.decode(byte_bpe.encode(docs(spark, ODD))).select("doc_id", "n_tokens", F.sha2("ids_le", 256), F.sha2("decoded", 256))
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, byte_bpe.digests(docs(spark, ODD)).collect()))
    odd = byte_bpe.encode(docs(spark, ODD))
    assert odd.count() == len(ODD) and byte_bpe.encode(docs(spark, [])).count() == 0
    for r in odd.collect():  # starts are byte offsets of the ids' own bytes
        pieces = byte_bpe.merger(byte_bpe.vocabulary()).pieces
        assert r["token_starts"] == np.cumsum([0, *(len(pieces[i]) for i in r["token_ids"])]).tolist()[: len(r["token_ids"])]


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(hit)


def test_more_documents_make_no_host_known_for_a_little(spark, data):
    measured = host_rules.measure(spark.read.parquet(f"{data}/documents.parquet")).cache()
    many = measured.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(60))))
    bad = list(host_rules.rules())
    failed = measured.select("host", *(c.cast("int").alias(k) for k, c in host_rules.rules().items()))
    whole = failed.agg(*(F.avg(k).alias(k) for k in bad)).first()
    own = {r["host"]: r for r in failed.groupBy("host").agg(*(F.avg(k).alias(k) for k in bad)).collect()}
    for rows in (measured, many):
        for r in host_rules.host_rates(rows).collect():
            for k in bad:
                if r[f"known_{k}"]:
                    assert own[r["host"]][k] > host_rules.LIFT * whole[k]
    slight = spark.createDataFrame([(h, 100 * (i % 100 < (11 if h == "a" else 10)), 100) for h in "abcdefghij" for i in range(20_000)], "host string, n_symbols long, n_words long")
    slight = slight.withColumns({"word_chars": 5 * F.col("n_words"), "n_dup_lines": F.lit(0), "n_lines": F.lit(1), "n_repeat_words": F.lit(0)})
    assert not [r for r in host_rules.host_rates(slight).collect() if r["known_symbols"]]


def test_host_rules(spark, data):
    rng = np.random.default_rng(2)
    for _ in range(60):
        text = "".join(rng.choice(["a ", "b ", "c\n", "a\n", "#%", "dé "], rng.integers(0, 60)))
        assert host_rules.measures(text) == brute_measures(text)
    assert_same(host_rules.op4_host_rules(spark, data), connect(data), host_rules.ORACLE)
    assert host_rules.judge(docs(spark, [])).count() == 0
    out = {r["doc_id"]: r for r in host_rules.judge(docs(spark, ODD)).collect()}
    assert not out[1]["kept"] and out[1]["n_words"] == 0 and out[6]["n_repeat_words"] == 40_000
    kept = host_rules.filter_kept(spark.read.parquet(f"{data}/documents.parquet"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept.count() == host_rules.op4_host_rules(spark, data).filter("kept").count()


def test_host_verdicts(spark):
    prose = "many plain words of a document that breaks no rule and goes on for a while so that it is long enough number"
    junk = prose.replace(" ", " # ")
    rows = [(i, f"{junk if i % 10 < k else prose} {i}", "en", host) for host, k, start in (("bad", 6, 0), ("good", 1, 200), (None, 0, 400)) for i in range(start, start + 100)]
    df = docs(spark, rows).withColumnRenamed("host", "_key").withColumnRenamed("score", "kept")
    out = {r["doc_id"]: r for r in host_rules.judge(df).collect()}
    assert all(out[i]["kept"] == (i % 10 >= 6) for i in range(100))  # junk of the bad host goes, its clean documents stay
    assert all(out[i]["kept"] for i in range(200, 300)) and all(out[i]["kept"] and out[i]["host_rules"] == [] for i in range(400, 500))
    kept = host_rules.filter_kept(df.unionByName(df.filter("doc_id < 20").withColumn("doc_id", F.lit(None).cast("long"))))
    assert kept.columns == df.columns and sorted(r["doc_id"] is None for r in kept.collect()) == [False] * 240 + [True] * 8
    rates = host_rules.host_rates(host_rules.measure(docs(spark, rows[:100])))
    assert not rates.first()["known_symbols"] and host_rules.host_rates(host_rules.measure(docs(spark, []))).count() == 0


def test_license_scan(spark, data):
    texts = {
        1: "Released under the MIT   License. SPDX-License-Identifier: Apache-2.0", 2: "the GNU General Public License version 3, or the Apache License", 3: "nothing at all", 4: None, 5: "",
        6: "submit license permit licenses", 7: "MIT\nLicense mit-license é mit license",
    }
    out = {r["doc_id"]: r for r in license_scan.scan_licenses(docs(spark, [(i, t, None, None) for i, t in texts.items()])).collect()}
    assert (out[1]["base_labels"], out[1]["labels"], out[1]["n_base"], out[1]["first_word"]) == ("mit", "apache-2.0,mit", 1, 3)
    assert out[2]["base_labels"] == "apache,gpl" and out[2]["labels"] == "apache,gpl,gpl-3.0"
    assert out[6]["n_base"] == 0 and (out[7]["n_base"], out[7]["first_word"], out[7]["last_word"]) == (3, 0, 5)
    assert all(out[i]["n_base"] == 0 and out[i]["first_word"] is None for i in (3, 4, 5))
    assert len(license_scan.signatures()) > 200
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r, t in zip(license_scan.op7_license_scan(spark, data).orderBy("doc_id").collect(), spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect(), strict=True):
        words = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t["text"]))
        places = [i for phrase, _ in license_scan.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.decode().split()]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(places, default=None), max(places, default=None))
    assert license_scan.scan_licenses(docs(spark, [])).count() == 0 and license_scan.scan_licenses(docs(spark, ODD)).count() == len(ODD)


def forms(name):
    """All texts that a rule stands for; a stretch of any words is left out."""
    m = re.search(r"\(\?:([^)]*)\)(\??)|\[([^\]]*)\](\{[0-9,]+\})?", name)
    if not m:
        return [name]
    ways = [*m[1].split("|"), *[""] * bool(m[2])] if m[1] is not None else [""] if m[4] else list(m[3])
    return [x for w in ways for x in forms(name[: m.start()] + w + name[m.end() :])]


def brute_labels(text):
    """Every regex over the whole text, without keywords; suppression over all pairs of detections."""
    flat = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) + " "
    best = {}
    for priority, label, _, _, rx in license_scan.signatures():
        for m in rx.finditer(flat):
            best.setdefault((m.start(), m.end(), label), priority)
    found = sorted((p, a - b, a, b, label) for (a, b, label), p in best.items())
    kept = []
    for d in found:
        if not any(k[2] <= d[2] and d[3] <= k[3] for k in kept):
            kept.append(d)
    return {k[4] for k in kept} | {label for phrase, label in license_scan.BASE if f" {phrase.decode()} " in flat}


def test_license_labels_same_as_brute_force(spark):
    rules = license_scan.signatures()
    assert len({r[4].pattern for r in rules}) == len(rules) > 300
    assert forms("gfdl 1 [12](?: only)?") == ["gfdl 1 1 only", "gfdl 1 1", "gfdl 1 2 only", "gfdl 1 2"]
    for _, label, _, keyword, rx in rules:
        assert len(keyword) > 2 and not re.search(r"[^)]\?(?!:|!|<)", rx.pattern.removeprefix(r"(?<!\S)").removesuffix(r"(?!\S)")), rx.pattern
        for text in forms(rx.pattern.removeprefix(r"(?<!\S)").removesuffix(r"(?!\S)")):
            assert rx.search(f" {text} ") and keyword in text, (label, text)
            assert set(license_scan.scan(text)[5].split(",")) == brute_labels(text), text
    texts = {1: "This work is available under Creative Commons Attribution 4.0", 2: "Creative Commons Zero", 3: "SPDX-License-Identifier: GFDL-1.2-or-later", 4: "Creative arts", 5: "published under Creative Commons Attribution 4.0", 6: "Creative Commons Zero applies"}
    out = {r["doc_id"]: r["labels"] for r in license_scan.scan_licenses(docs(spark, [(i, t, None, None) for i, t in texts.items()])).collect()}
    assert out == {1: "cc-by-4.0", 2: "cc0-1.0", 3: "gfdl", 4: "", 5: "cc-by-4.0", 6: "cc0-1.0"}
    rng = np.random.default_rng(3)
    pieces = [f for r in rules[::3] for f in forms(r[4].pattern[7:-6])[:1]] + ["the", "license", "under", "gpl"]
    mixed = [" ".join(rng.choice(pieces, 12)) for _ in range(60)]
    whole = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    for text in [*mixed, *whole]:
        assert set(filter(None, license_scan.scan(text or "")[5].split(","))) == brute_labels(text), text


def test_language(spark):
    folder = "/root/testdata/sf0.01"
    out = language_codes.op6_language_codes(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.97
    model = language_codes.train(docs(spark, [(1, "the cat and the dog", "en", None), (2, "le chat et le chien", "fr", None)]))
    got = [r["lang_pred"] for r in language_codes.identify(docs(spark, [(1, None, None, None), (2, "123 !", None, None), (3, "the dog", None, None)]), model).orderBy("doc_id").collect()]
    assert got == ["und", "und", "en"]
    assert language_codes.identify(docs(spark, ODD), language_codes.train(docs(spark, []))).filter("lang_pred <> 'und'").count() == 0
    for n in (2, 3, 4, 5, 9, 30):
        assert len(np.unique(language_codes.codewords(n), axis=0)) == n


def test_toxicity(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(d, labels)
    restore = toxicity.Restorer(model.characters)
    for said in ("you 1d10t", "i d i o t", "st*pid p4thet!c", "loooooser", "tr@sh", "d.i.s.g.u.s.t.i.n.g", "$cum m0r0n"):
        assert model.score(restore(said)[0]) >= 0.3, restore(said)
    assert model.score(restore("The and of to is the that.")[0]) < 0.3
    out = toxicity.score(d.join(labels, "doc_id").filter(toxicity.held_out()), model).join(labels, "doc_id")
    rows = [(r["score"], r["toxic"]) for r in out.collect()]
    pos, neg = np.array([s for s, y in rows if y]), np.array([s for s, y in rows if not y])
    assert np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None])) > 0.9
    assert toxicity.score(docs(spark, ODD), model).filter("predicted = 1").count() == 0
    empty = toxicity.train(docs(spark, []), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs(spark, ODD), empty).count() == len(ODD)


def test_viterbi_same_as_all_readings():
    rng = np.random.default_rng(8)
    counts = rng.integers(0, 50, toxicity.K**3).astype(float)
    model = toxicity.log_model(counts)

    def score(reading, costs):
        a = b = 0
        total = costs
        for z in [*map(toxicity.symbol, reading), 0]:
            total += float(model[a, b, z])
            a, b = b, z
        return total

    spans = ["1d10t", "b00b", "a$$", "st*p!d", "i d 1 o t", "looooser", "$$$h1t", "a.b", "x_y-z", "0", "(@f3", "aaa1", "n-0-p", "7r@$#"]
    spans += ["".join(rng.choice(list("ab13$*@. -"), rng.integers(2, 7))) for _ in range(40)]
    for span in spans:
        readings = [("", 0.0)]
        for choices in toxicity.lattice(span):
            readings = [(r + x, c + cost) for r, c in readings for x, cost in choices]
        best = max(score(r, c) for r, c in readings)
        got = toxicity.viterbi(span, model)
        assert any(r.strip() == got and abs(score(r, c) - best) < 1e-4 for r, c in readings), span
    long = "1 d 1 0 t " * 2000
    assert len(toxicity.viterbi(long, model)) > 2000  # no slices, no prefix


def test_toxicity_same_as_counting(spark):
    """Shares of features against plain counting, and ties: the greatest share decides, whichever feature has it."""
    rng = np.random.default_rng(13)
    vocabulary = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        words = list(rng.choice(vocabulary, 30))
        toxic = int(i % 4 == 0)
        rows.append((i, " ".join(words + (["nastyx", "vilezz"] if toxic else [])), "en", "a"))
        labels.append((i, toxic))
    model = toxicity.train(docs(spark, rows), spark.createDataFrame(labels + labels[:50] + [(None, 1), (3, None)], "doc_id long, toxic int"))
    free = {r["doc_id"] for r in docs(spark, rows).filter(toxicity.may_learn()).select("doc_id").collect()}
    n = {y: sum(1 for i, y2 in labels if i in free and y2 == y) for y in (0, 1)}
    base = n[1] / (n[0] + n[1])
    want = (n[1] + toxicity.PRIOR * base) / (n[1] + toxicity.PRIOR)
    assert abs(model.share["nastyx"] - want) < 1e-12 and model.share["nastyx"] == model.share["vilezz"]
    out = {r["doc_id"]: r for r in toxicity.score(docs(spark, rows), model).collect()}
    assert all(out[i]["score"] == (want if y else model.without) and out[i]["predicted"] == y for i, y in labels)


def test_codeword_decoding_same_as_brute_force(spark):
    rng = np.random.default_rng(14)
    names = [f"l{i:03d}" for i in range(70)]
    alphabets = {k: rng.choice([chr(0x4E00 + 40 * i + j) for j in range(40)], 12) for i, k in enumerate(names)}
    rows = [(i, "".join(rng.choice(alphabets[names[i % 70]], 40)), names[i % 70], None) for i in range(280)]
    model = language_codes.train(docs(spark, rows))
    assert model.languages == names and model.codes.shape[0] == 70  # more than any fixed number of languages
    hits = 0
    for _, text, lang, _ in rows[:140]:
        m = model.margins(text)
        loss = [sum(model.trust[b] * np.log1p(np.exp(-8.0 * (1 if code[b] else -1) * m[b])) for b in range(len(m))) for code in model.codes]
        got, score, ambiguous = model.decode(text)
        assert got == names[int(np.argmin(loss))] and ambiguous == (sorted(loss)[1] - min(loss) < language_codes.AMBIGUOUS)
        assert abs(score - 1 / sum(np.exp(-4.0 * (x - min(loss))) for x in loss)) < 1e-9
        hits += got == lang
    assert hits >= 130
    for n in (1, 2, 6, 65, 300):
        assert len(np.unique(language_codes.codewords(n), axis=0)) == n
