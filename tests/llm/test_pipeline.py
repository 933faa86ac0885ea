import corpus_pipeline
from smishlake.llm import byte_bpe, cube_mix, host_rules, jaccard_join, toxicity


def test_pipeline_same_as_its_operators(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = toxicity.train(docs, labels.select("doc_id", "toxic"))
    restore = toxicity.Restorer(model.characters)
    clean = {i for i, r in rows.items() if model.score(restore(r["text"])[0]) < toxicity.THRESHOLD}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, data)
        assert docs.columns == before.columns, name
        ids = sorted(r["doc_id"] for r in docs.collect())
        if name == "toxicity":
            assert set(ids) == clean
        if name == "quality_rules":
            assert ids == sorted(r["doc_id"] for r in host_rules.judge(before).filter("kept").collect())
        if name == "jaccard_join":
            assert ids == sorted(r["doc_id"] for r in jaccard_join.near_duplicates(before).filter("doc_id = component_id").collect())
        if name == "source_mix":
            copies = {r["doc_id"]: r["copies"] for r in cube_mix.mix(before).collect()}
            assert ids == sorted(i for i, n in copies.items() for _ in range(n))
    out = corpus_pipeline.run(spark, data).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, byte_bpe.digests(docs).collect()))


def test_mix_stage_with_null_and_repeated_ids(spark, data):
    rows = [(i, f"one two three {i}", "en", "a", 15) for i in range(20)] + [(5, "one two three 5", "en", "a", 15)] * 3 + [(6, "other words here 6", "en", "a", 18)]
    rows += [(None, f"no id {i}", "en", "a", 7) for i in range(6)] + [(None, "neither id nor source", "en", None, 21), (None, None, "en", None, 0), (30, "", "en", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sizes = [(r["doc_id"] is None, r["doc_id"], r["source"] or "", r["size"]) for r in cube_mix.mix(df).collect() for _ in range(r["copies"])]
    got = corpus_pipeline.mix_sources(spark, df, data).collect()
    order = lambda x: sorted(x, key=repr)
    assert order((r["doc_id"] is None, r["doc_id"], r["source"] or "", len((r["text"] or "").split())) for r in got) == order(sizes)
    assert any(r["doc_id"] is None for r in got) and any(r["source"] is None for r in got)
    assert all(got.count(r) <= 2 * rows.count(tuple(r)) for r in got)


ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, _key string, _copies int, _n int, id long, kept boolean, component_id long, size long, copies int, sketch binary"


def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns of names that the stages use."""
    prose = "these are plain words of a text that goes on for long enough to be kept by every rule there is and number"
    rows = [(i, f"{prose} {i}", "en", f"s{i % 3}") for i in range(30)]
    rows += [(5, f"{prose} 5", "en", "s2")] * 2 + [(100, f"{prose} 5", "en", "s1"), (101, f"{prose} 5", None, None), (None, f"{prose} 77", "en", "s0"), (None, None, None, None), (102, None, "en", "s0"), (103, "", "en", "s0"), (104, " \n", None, "s1")]
    rows += [(105, " ".join(f"word{i}" for i in range(30_000)), "en", "s1"), (106, "ab " * 3, "en", "s1"), (107, "# $ % " * 40, "en", "s1")]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 7, "x", 3, None, 1, True, 2, 4, 5, None) for r in rows], ODD_SCHEMA)


def plain(rows):
    return sorted((repr(tuple(r)) for r in rows))


def test_stages_take_odd_rows(spark, data):
    df = odd_documents(spark)
    given = plain(df.collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, data)
        assert stage(spark, df.limit(0), data).count() == 0, name
        if name == "byte_bpe":
            assert out.count() == df.count() and out.filter("doc_id IS NULL").count() == 2
            continue
        assert out.columns == df.columns, name
        got = plain(out.collect())
        if name == "toxicity":
            assert got == given  # nothing here is toxic; rows without an id or a text stay
        elif name == "quality_rules":
            short = {102, 103, 104, 106, 107}
            assert got == plain(r for r in df.collect() if r["text"] and r["doc_id"] not in short)
        elif name == "jaccard_join":
            gone = {100, 101} | {i for i in range(30) if i}  # one sentence, numbered: a single group, 0 stands for it
            kept = plain(r for r in df.collect() if r["doc_id"] is None or r["doc_id"] not in gone)
            assert got == kept, (len(got), len(kept))
        else:
            assert set(got) <= set(given) and all(got.count(r) <= 2 * given.count(r) for r in set(got)) and not any(r["text"] is None or not r["text"].strip() for r in out.collect())
