import datetime
import ipaddress

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from smishlake.operators import augment, brands, campaigns, conversations, fingerprint, indicators, networks, reports, scoring, text, training, urls
from smishlake.sources import tables as S


def messages(spark, *texts, sender=""):
    rows = [(i, t, sender) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "msg_id long, raw_text string, sender_id string").withColumn("received_at", F.timestamp_seconds(F.lit(1704067200) + F.col("msg_id") * 60))


def by_id(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.orderBy("msg_id").select("msg_id", *cols).collect()]


def test_normalisation_examples(spark):
    df = text.normalize(messages(spark, "Please renew your ticket.", "apna account update kro jaldi", "upd8 y0ur acnt 1mmediately", "pleaaase uuuuupdate", "A" * 10000, "a" * 2500 + "b" * 2500, "   ", None, "b​lo​cked", "ｂａｎｋ"))
    out = by_id(df, "normalized_text", "n_transformations")
    assert out[0] == ("Please renew your ticket.", 0)
    assert out[1][1] >= 1
    assert "your" in out[2][0] and "immediately" in out[2][0]
    assert out[3][0].startswith("please") and out[3][0].endswith("update")
    assert (out[4][0], out[5][0], out[6][0], out[7][0]) == ("A", "ab", "", "")
    assert out[8][0] == "blocked" and out[9][0] == "bank"
    lang = by_id(df, "language")
    assert lang[1] == "en" or lang[1] == "hinglish"


def test_normalisation_is_one_pass_in_slices(spark, monkeypatch):
    df = text.normalize(messages(spark, "Acnt b1ocked!"), log=False)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_replace" not in plan
    import pyarrow as pa

    monkeypatch.setattr(text, "SLICE", 2)
    odd = ["a\x1cb  c", "AAAa b-l-c-k", None, "क़ ऩﬁ", "b'l'c'k ACNT, upd8", "\t x\x85y "]
    got = text._sliced(pa.array(odd), text.CLEANED_LOGGED, True).to_pylist()
    assert [g["text"] for g in got] == ["a\x1cb c", "A block", "", "क़ ऩfi", "block ACCOUNT updb", "x y"]
    assert [g["n"] for g in got] == [len(g["log"]) for g in got] == [1, 3, 0, 1, 3, 1]


def test_analysis_is_one_python_pass(spark):
    # one worker a task: texts are not sent back and then to a second worker for the patterns
    m = messages(spark, "Acnt b1ocked! Verify now http://hdfc-verify.top/card", None, sender="AX-SBIINB")
    for parts in (("scores",), scoring.PARTS):
        for log in (False, True):
            df = scoring.analyze_messages(m, parts=parts, log=log)
            assert df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    apart = scoring.score_messages(text.normalize(m, max_chars=13, log=False))
    once = scoring.analyze_messages(m, max_chars=13, parts=("scores",), log=False)
    assert sorted(map(str, once.select(sorted(once.columns)).collect())) == sorted(map(str, apart.select(sorted(apart.columns)).collect()))


def test_worker_gets_small_batches_and_keeps_texts(spark):
    # what a Python worker holds is bounded by bytes, and a text that no column needs does not come back
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 1 << 26)
    texts = ["Acnt b1ocked! Verify now http://hdfc-verify.top/card", "apka\tkro", "आपके खाते", "€ no £", None, "", "aaAA", "a\x1c  b"]
    m = messages(spark, *texts, sender="AX-SBIINB")
    lean, whole = (scoring.analyze_messages(m, log=False, keep_text=k) for k in (False, True))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == text.BATCH_BYTES <= 1 << 23
    assert "normalized_text" not in lean.columns
    assert sorted(map(str, lean.collect())) == sorted(map(str, whole.drop("normalized_text").collect()))
    bare = text.normalize(m, log=False, keep_text=False)
    assert by_id(bare, "language", "n_transformations") == by_id(whole, "language", "n_transformations")
    assert by_id(text.detect_language(whole.select("msg_id", "normalized_text")), "language", "scripts") == by_id(whole, "language", "scripts")


def test_word_passes():
    # one word at a time: passes feed one another, hits are logged pass by pass, capitals are kept
    assert text.restore_word("plain") == ("plain", ())
    assert text.restore_word("BLCKD") == ("BLOCKED", ([], [("BLCKD", "BLOCKED")], [], []))
    assert text.restore_word("upd8") == ("updb", ([("upd8", "updb")], [], [], []))
    assert text.restore_word("Acnt") == ("Account", ([], [], [], [("Acnt", "Account")])) and text.restore_word("ACNT,")[0].startswith("ACCOUNT")
    assert [text._titled(w) for w in ("Abc", "Abc-Def", "ABc", "abc", "12", "Éa", "A")] == [True, True, False, False, False, True, True]


def test_partitions_do_not_matter(spark, data):
    from smishlake.plans.queries import QUERIES

    whole = sorted(map(tuple, QUERIES["manipulation"](spark, data).collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    assert sorted(map(tuple, QUERIES["manipulation"](spark, data).collect())) == whole
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_scores(spark):
    a = scoring.analyze_messages(messages(
        spark, "Lunch is moved to half past one, see you there.", "AX-SBIINB: your savings account stays blocked until the KYC form is filled in. Click https://sbi-kyc-desk.xyz/form immediately.",
        "One parcel waits for clearance, settle the fee at http://desk.example.live", "बिजली विभाग: बिल बाकी है, कनेक्शन आज काट दिया जाएगा, तुरंत भुगतान करें।", "Power office notice: supply ends tonight because of an unpaid challan, call 9123456780 immediately."))
    out = by_id(a, "scam_family", "risk_score", "risk_level")
    assert out[0][2] in ("SAFE", "LOW")
    assert out[1][0] == "BANK_KYC" and out[1][1] >= 80
    assert out[2][0] == "COURIER" and out[3][0] == "GOVERNMENT" and out[3][1] >= 50 and out[4][0] == "GOVERNMENT"


def test_brands(spark):
    def decide(body, sender):
        r = brands.match_brands(text.normalize(messages(spark, body, sender=sender))).first()
        return r["claimed_brand"], r["impersonation_detected"]

    assert decide("The SBI statement can be read at onlinesbi.sbi as always.", "AX-SBIINB") == ("State Bank of India", False)
    assert decide("PAN and KYC of the SBI account are due, act immediately.", "VM-HDFCBK") == ("State Bank of India", True)
    assert decide("The SBI counter near the station was crowded when I paid in the rent.", "") == ("State Bank of India", False)
    assert decide("nothing here", "") == (None, False)


def test_urls(spark):
    cases = {
        "http://axis-kyc.icu/form": "SUSPICIOUS_TLD", "http://one.two.three.four.five.example.org/": "EXCESSIVE_SUBDOMAIN_DEPTH", "http://shop.buzz.top/Q7vLw2ZrT9xKb4NfYcHsJ1mPdG8eRu3A?k=zX5tW0qB": "HIGH_URL_ENTROPY",
        "http://example.org/free-gift/bonus?ref=9": "SUSPICIOUS_PATH_TOKENS", "http://portal.example.org/?aadhaar=confirm": "CREDENTIAL_HARVESTING_PATH", "http://icici-card.example.top/otp": "BRAND_IMPERSONATION_IN_DOMAIN",
        "http://xn--hdfc-bnk.example.org/": "PUNYCODE_DOMAIN", "http://8.9.10.11/login": "IP_LITERAL_URL", "http://cutt.ly/a1b2c3": "URL_SHORTENER", "http://example.org/%253Cscript": "DOUBLE_ENCODING",
        "http://root:hunter2@files.example.org/": "EMBEDDED_CREDENTIALS", "http://files.example.org:8443/get": "SUSPICIOUS_PORT", "http://jump.example.top/go?to=https://pay.example.click/x": "NESTED_URL", "http://example.org/read#https://pay.example.top/now": "REDIRECT_VIA_FRAGMENT",
        "http://a@b.example.org@c.example.top/": "MULTIPLE_AT_SIGNS", "http://127.0.0.1/": "SSRF_BLOCKED", "http://[::1]/": "SSRF_BLOCKED", "ftp://a.b/": "SSRF_BLOCKED", "http://files.example.org:70000/": "MALFORMED_URL",
    }
    df = urls.url_findings(spark.createDataFrame([(u,) for u in [*cases, "http://example.org/contact", "http://icici.co.in/branches", None]], "url string"))
    got = {r["url"]: [f["finding_id"] for f in r["findings"]] for r in df.collect()}
    for u, finding in cases.items():
        assert finding in got[u], (u, got[u])
    assert got["http://example.org/contact"] == [] and "BRAND_IMPERSONATION_IN_DOMAIN" not in got["http://icici.co.in/branches"] and got[None] == ["SSRF_BLOCKED"]


def test_indicators(spark):
    m = messages(spark, "call 9123456780 or +91 7012345678, 919123456780; not 24680 or 0000000000", "mail Desk@Shop.Example.IN, pay grocer@okaxis grocer@OKAXIS", "see (http://example.org/contact). 9.9.9.9 and 10.20.30.40, [::1]; AX-SBIINB", None)
    got = {(r["type"], r["value"]): r["ssrf_risk"] for r in indicators.extract_indicators(m).collect()}
    assert {v for t, v in got if t == "phone"} == {"+919123456780", "+917012345678"}
    assert ("email", "desk@shop.example.in") in got and ("upi_id", "grocer@okaxis") in got and ("sender_id", "AX-SBIINB") in got
    assert got[("ip", "9.9.9.9")] == "safe" and got[("ip", "10.20.30.40")] == "private_ip" and got[("ip", "[::1]")] == "loopback" and ("url", "http://example.org/contact") in got


def test_conversation(spark):
    turns = ["Dear customer, we are contacting you", "We are calling from official department of SBI", "Your account will be blocked immediately", "Please share the OTP", "Please share the OTP"]
    c = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    s = conversations.staged(c)
    r = conversations.conversation_results(s).first()
    assert r["message_count"] == 4 and r["warnings"] == ["REPEATED_MESSAGES"] and r["is_progression"] and r["advancement"] > 0.3
    n = conversations.predict_next_step(conversations.conversation_results(s), conversations.transitions(s, conversations.stage_graph(spark)), conversations.stage_actions(spark)).first()
    assert n["action"] and 0 <= n["probability"] <= 1
    timed = c.withColumn("ts", F.timestamp_seconds(F.lit(100) - F.col("turn")))
    assert conversations.order_messages(timed).filter("time_reversed").count() == 4


def test_stage_patterns_are_counted_in_one_pass(spark):
    import re

    from smishlake.functions import constants as C

    texts = ["Dear customer, pay pay Rs. 500 within 2 hours; otp_otp OTP otp", "we  are calling from official department, नमस्ते नमस्ते", "5 rs 6rs x5 rupees, one-time password; RBI approved", "Thank you for your patience, the case closed", "", "unpaid repay payé"]
    count = lambda p, t: sum(1 for _ in re.finditer(rf"(?<!\w)(?ai:{p})(?!\w)", t.lower()))
    for t in texts:
        want = [count(latin, t) + (len(re.findall(deva, t)) if deva else 0) for _, latin, deva in C.STAGES]
        assert conversations.pattern_counts(t) == (*want, count(C.BENIGN, t))
    plan = conversations.single_messages(messages(spark, *texts))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_count" not in plan and "regexp_extract" not in plan


def test_fingerprint_pairs(spark):
    m = messages(spark, "SBI KYC blocked http://sbi-kyc.click/a now", "Your SBI KYC is blocked http://sbi-kyc.click/a today", "part time job, daily salary")
    a = campaigns.text_vectors(scoring.analyze_messages(m))
    pairs = fingerprint.entity_pairs(fingerprint.build_fingerprints(a, indicators.extract_indicators(m))).collect()
    assert [(p["id_a"], p["id_b"]) for p in pairs] == [(0, 1)] and pairs[0]["composite"] >= 0.6


def test_top_partners_of_large_blocks(spark, monkeypatch):
    texts = [f"SBI KYC blocked http://sbi-kyc.click/a now {'please ' * (i % 7)}{i % 40}" for i in range(90)] + [f"part time job number {i % 3}" for i in range(9)] + ["pay merchant@okaxis", "see you at four"]
    m = messages(spark, *texts)
    f = fingerprint.build_fingerprints(campaigns.text_vectors(scoring.analyze_messages(m)), indicators.extract_indicators(m))
    f = S.persist_table(f, "test-fingerprints")
    pairs = fingerprint.entity_pairs(f).collect()
    assert len([p for p in pairs if p["id_b"] < 90]) == 90 * 89 // 2
    ends = [(p[a], -p["composite"], p[b], p["association"]) for p in pairs for a, b in (("id_a", "id_b"), ("id_b", "id_a"))]
    want = sorted((i, -s, j, x, n + 1) for i in {e[0] for e in ends} for n, (_, s, j, x) in enumerate(sorted(e for e in ends if e[0] == i)[:3]))
    for shard in (7, 1024):
        monkeypatch.setattr(fingerprint, "SHARD", shard)
        got = sorted((r["id_a"], r["composite"], r["id_b"], r["association"], r["rank"]) for r in fingerprint.top_partners(f, 3).collect())
        assert got == sorted(want)
    assert fingerprint.top_partners(f.limit(0), 3).count() == 0


def test_campaigns(spark):
    m = messages(spark, *["SBI account blocked, update KYC now at branch %d" % (i % 2) for i in range(4)], *["lottery prize winner claim number %d" % (i % 2) for i in range(4)])
    a = campaigns.text_vectors(scoring.analyze_messages(m))
    for found in (campaigns.assign_linked(a, 0.8), campaigns.assign_campaigns(a, 0.8)):
        assert campaigns.purity(a.select("msg_id", "scam_family").join(found, "msg_id"), "scam_family").first()["purity"] == 1.0


def vectors(n, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, dim))
    return [(base[rng.integers(0, 12)] + rng.normal(size=dim) * 0.35).tolist() for _ in range(n)]


def test_assignment_same_as_one_by_one(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, f"t{i % 140}", "AB"[i % 2] if i % 29 else None, int(rng.integers(0, 40)), v) for i, v in enumerate(vectors(160))]
    rows += [(900, "zero", "A", 5, [0.0] * 8), (901, "none", "A", 5, None), (902, "zero too", "A", 6, [0.0] * 8)]
    df = spark.createDataFrame([(i, t, f, at, v, "clash", 1) for i, t, f, at, v in rows], "msg_id long, raw_text string, scam_family string, at int, embedding array<double>, leader string, best int")
    df = df.withColumn("received_at", F.timestamp_seconds("at"))
    first = {}
    for i, t, *_ in sorted(rows):
        first.setdefault(t, i)
    camps, want = {}, {}
    for i, t, f, at, v in sorted(rows, key=lambda r: (r[3], r[0])):
        if first[t] != i:
            continue
        u = np.array(v) / np.linalg.norm(v) if v and any(v) else None
        mine = camps.setdefault(f, [])
        old = [(round(float(np.dot(u, c["mean"])), 12), -k) for k, c in enumerate(mine) if u is not None and c["mean"] is not None]
        best = max(old, default=(-2, 0))
        if best[0] >= 0.82:
            c = mine[-best[1]]
            c["n"] += 1
            mean = (c["mean"] * c["n"] + u) / (c["n"] + 1)
            c["mean"] = mean / np.linalg.norm(mean)
            want[i] = (f"{f or ''}-{c['id']}", round(best[0], 4), False)
        else:
            want[i] = (f"{f or ''}-{i}", 1.0, True)
            mine.append({"id": i, "n": 1, "mean": u})
    assert 20 < sum(w[2] for w in want.values()) < 150
    frozen = {c["id"]: c["mean"] for mine in camps.values() for c in mine}
    for block, replayed in ((3, 2), (4096, 512)):
        monkeypatch.setattr(campaigns, "REPLAYED", replayed)
        members, centroid = campaigns.assign_with_centroids(df, block=block)
        got = {r["msg_id"]: r for r in members.collect()}
        assert set(got) == {r[0] for r in rows}
        for i, t, *_ in rows:
            w = want[first[t]]
            assert got[i]["campaign_id"] == w[0] and got[i]["is_duplicate"] == (first[t] != i) and got[i]["is_new"] == (w[2] and first[t] == i)
            assert abs(got[i]["similarity"] - (1.0 if first[t] != i else w[1])) < 1e-9
        for r in centroid.collect():
            mean = frozen[int(r["campaign_id"].split("-")[-1])]
            assert not any(r["centroid"]) if mean is None else np.allclose(r["centroid"], mean)
    assert campaigns.assign_campaigns(df.limit(0)).count() == 0


def test_near_pairs_find_what_brute_force_finds(spark, monkeypatch):
    rows = [(i, v, i % 3) for i, v in enumerate(vectors(400, 16, 3))] + [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, vectors(1, 16)[0], None), (1003, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, y in rows if v and any(v) and y is not None and len(v) == 16}
    ids = sorted(unit)
    monkeypatch.setattr(campaigns, "BLOCK", 16)
    for threshold, least in ((0.82, 0.97), (0.3, 1.0)):
        want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if a % 3 == b % 3 and unit[a] @ unit[b] >= threshold}
        got = {(r["id_a"], r["id_b"]) for r in campaigns.near_pairs(df, threshold, "vec_id", group_col="label").collect()}
        assert got <= want and len(got) >= least * len(want) > 100
    assert campaigns.hyperplanes(0.82, 1 << 30)[0] > campaigns.hyperplanes(0.82, 1000)[0] and campaigns.hyperplanes(0.3, 1000) == (0, 1)


def test_campaign_tables(spark, tmp_path):
    m = messages(spark, *["SBI account blocked, update KYC now at branch %d" % (i % 2) for i in range(4)], "lottery prize winner claim number", sender="AX-SBIINB")
    a = campaigns.word_vectors(scoring.analyze_messages(m))
    members = a.join(campaigns.assign_campaigns(a, 0.8), "msg_id")
    hosts = spark.createDataFrame([(0, "a.example"), (0, "b.example"), (2, "c.example"), (1, "b.example")], "msg_id long, value string")
    campaigns.write_campaigns(members, str(tmp_path), hosts)
    campaigns.write_campaigns(members, str(tmp_path), hosts)  # again: replaces
    c = {r["campaign_id"]: r for r in spark.read.parquet(f"{tmp_path}/campaigns").collect()}
    assert [f.name for f in spark.read.parquet(f"{tmp_path}/campaigns").schema] == [f.name for f in StructType.fromDDL(S.SCHEMAS["campaigns"])]
    assert [f.name for f in spark.read.parquet(f"{tmp_path}/campaign_members").schema] == [f.name for f in StructType.fromDDL(S.SCHEMAS["campaign_members"])]
    assert sum(r["member_count"] for r in c.values()) == 3 == spark.read.parquet(f"{tmp_path}/campaign_members").count()
    first = next(r for k, r in c.items() if k.endswith("-0"))
    assert first["domains"][:2] == ["a.example", "b.example"] and first["senders"] == ["AX-SBIINB"]
    write = campaigns.append_members(f"{tmp_path}/stream")
    batch = members.select("campaign_id", "msg_id")
    write(batch, 0)
    write(batch.limit(1), 1)
    write(batch, 0)
    assert spark.read.parquet(f"{tmp_path}/stream/campaign_members").count() == 6


def test_providers(spark):
    ind = indicators.extract_indicators(messages(spark, "see http://a.example/x?u=1 and http://b.example/y, pay merchant@okaxis", "http://A.example/x"))
    lists = spark.createDataFrame([("url_prefix", "http://a.example/x", "p", 0.3), ("url_host", "a.example", "h", 0.1), ("domain", "b.example", "d", 0.2), ("upi_id", "merchant@okaxis", "u", 0.0), ("url_host", "a.example", "z", 0.1)], "kind string, listed string, threat_category string, reputation_score double")

    def down():
        raise OSError("down")

    got = sorted((r["msg_id"], r["type"], r["provider"], r["threat_category"]) for r in indicators.enrich_all(ind, {"one": lists, "down": down, "two": lambda: lists.limit(0)}).collect())
    assert got == [(0, "domain", "one", "d"), (0, "upi_id", "one", "u"), (0, "url", "one", "h"), (1, "url", "one", "h")]
    assert indicators.enrich_all(ind, {"down": down}).count() == 0
    rolled = {(r["type"], r["value"]): r["enrichment_count"] for r in indicators.roll_up(ind, indicators.enrich_all(ind, {"one": lists})).collect()}
    assert rolled[("domain", "b.example")] == 1 and rolled[("domain", "a.example")] == 0
    twice = brands.find_by_alias(spark.createDataFrame([("pay SBI",), ("pay SBI",), (None,)], "t string"), "t")
    assert [r["n_orgs"] > 0 for r in twice.collect()].count(True) == 2 and twice.count() == 3


def test_campaign_steps_are_filled_by_all_families(spark):
    rows = spark.range(90).selectExpr("if(id < 60, 'a', 'b') AS family", "id", "id AS at", "array(1D, 0D) AS v")
    assert campaigns.steps_of(rows, 10) == 6 and campaigns.steps_of(rows.limit(0), 10) == 0
    sizes = {(r["family"], r["block"]): r["count"] for r in campaigns._numbered(rows, 6).groupBy("family", "block").count().collect()}
    assert sizes == {**{("a", k): 10 for k in range(6)}, **{("b", k): 5 for k in range(6)}}


def test_campaign_steps_are_few(spark):
    # a step costs a pass over the campaigns, whatever its messages: what fits in its vectors goes in one
    rows = spark.range(16_000).selectExpr("'a' AS family", "id", "id AS at", "array(1D, 0D) AS v")
    assert campaigns.steps_of(rows, campaigns.STEP_MESSAGES) == 1
    wide = rows.selectExpr("family", "id", "at", "array_repeat(1D, 256) AS v")
    assert campaigns.steps_of(wide, campaigns.STEP_MESSAGES) == 2  # vectors stay bounded


def test_top_indicators_scan_the_texts_once(spark, data):
    from smishlake.plans.queries import QUERIES

    plan = QUERIES["ioc_top_values"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "raw_text" not in plan and "regexp_extract_all" not in plan


def test_variants_come_from_one_pass(spark):
    v = augment.augment_messages(messages(spark, "Your BANK account, please", None), ("adjacent_swap", "mixed_scripts"))
    assert "transform(" not in v._jdf.queryExecution().optimizedPlan().toString()
    assert v.count() == 4 and augment.perturb("Your BANK account, please", "mixed_scripts", 1).split(" ")[1] == "बैंक"
    assert augment.perturb("l0ng words stay", "number_substitution", 5) == augment.perturb("l0ng words stay", "number_substitution", 5)


def test_augmentation_is_repeatable(spark):
    m = messages(spark, "Your account is blocked, click http://sbi.co.in now please", None)
    one = sorted(map(tuple, augment.augment_messages(m).collect()), key=repr)
    two = sorted(map(tuple, augment.augment_messages(m.repartition(3)).collect()), key=repr)
    assert one == two and len(one) == 2 * len(augment.PERTURBATIONS)


def test_robustness_counts_every_perturbation(spark, data):
    from smishlake.plans.queries import QUERIES

    n = S.read_table(spark, data, "documents").count()
    found = {(r["level"], r["name"]): r["n"] for r in QUERIES["robustness"](spark, data).collect()}
    assert {name: n for name in augment.PERTURBATIONS} == {name: k for (level, name), k in found.items() if level == "perturbation"}
    assert found["all", "all"] == n * len(augment.PERTURBATIONS)


def test_representatives_of_a_large_block_are_sent_a_few_times(spark, monkeypatch):
    m = messages(spark, *[f"SBI account {'x' * i} blocked, update KYC at http://sbi.example/{i}" for i in range(90)])
    f = fingerprint.build_fingerprints(campaigns.word_vectors(scoring.analyze_messages(m)), spark.createDataFrame([(i, "shared") for i in range(90)], "msg_id long, value string"))
    pick = lambda: sorted(map(tuple, fingerprint.top_partners(f, 3).collect()))
    want = pick()
    copies = [r[0] for r in spark.createDataFrame([(1000,), (100_000,), (1_000_000,)], "n long").select(fingerprint.shards_of(F.col("n"))).collect()]
    assert copies == [1, 16, 123]  # not 1, 98, 977
    monkeypatch.setattr(fingerprint, "SHARD", 5)
    monkeypatch.setattr(fingerprint, "SHARDS", 2)
    assert pick() == want and len(want) == 270


def test_variants_are_scored_in_the_pass_that_makes_them(spark):
    m = messages(spark, "Your SBI account is blocked, click http://sbi.co.in now please", "", None, "Bhai apka acnt kal band ho jayega!", "Your SBI account is blocked, click http://sbi.co.in now please")
    got = augment.scored_variants(m, keep_text=True)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 0
    want = scoring.score_messages(text.normalize(augment.augment_messages(m), log=False))
    same = ["msg_id", "perturbation", "raw_text", "n_transformations", "language", "scam_family", "risk_score", "risk_level", "fear", "link"]
    pick = lambda df: sorted(map(tuple, df.select(*same).collect()), key=repr)
    assert pick(got) == pick(want) and got.count() == 5 * len(augment.PERTURBATIONS)
    assert augment.scored_variants(m).filter("raw_text IS NOT NULL").isEmpty()


def test_training(spark):
    df = spark.createDataFrame([("Your OTP is 1234",), ("yourotpis1234",), ("YOUR OTP IS 1234 ",), ("other",)], "text string")
    assert sorted(r["n"] for r in training.template_groups(df).collect()) == [1, 3]
    many = spark.createDataFrame([(f"template {i % 100} number",) for i in range(300)], "text string")
    for split in (training.leakage_free_split(many), training.exact_split(many)):
        assert split.count() == 300 and training.split_overlap(split).isEmpty()
    sizes = {r["split"]: r["n"] for r in training.exact_split(many).groupBy("split").agg(F.count_distinct("template").alias("n")).collect()}
    assert sizes == {"train": 70, "val": 10, "test": 20} and training.exact_split(many.limit(0)).count() == 0
    judged = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "c")], "label string, predicted string")
    assert training.overall_metrics(training.class_metrics(judged)).first()["accuracy"] == 0.5


def test_privacy_and_intake(spark):
    assert spark.range(1).select(reports.redact(F.lit("password=abc token: x, Bearer zzz"))).first()[0] == "password=<redacted> token=<redacted> Bearer <redacted>"
    ok, bad = S.accept_messages(messages(spark, "fine", "", None, "x" * 6000))
    assert ok.count() == 1 and sorted(r["reject_reason"] for r in bad.collect()) == ["empty", "empty", "too_long"]
    assert S.key_violations(messages(spark, "a", "a", "b"), "raw_text").count() == 1
    assert set(S.UNIQUE) == set(S.SCHEMAS) and len(S.SCHEMAS) == 9
    m = messages(spark, "a", "b")
    broken = {r["name"]: r["n"] for r in S.check_keys({"messages": m.unionByName(m.limit(1)), "analyses": spark.range(1, 5).select(F.col("id").alias("msg_id"))}).collect()}
    assert broken == {"messages.msg_id": 1, "analyses.msg_id": 0, "analyses.msg_id->messages": 3}


def test_addresses_same_as_the_standard_library(spark):
    rng = np.random.default_rng(9)
    texts = ["::", "::1", "[::1]", "1::", "fe80::1%eth0", "fe80::1%", "fe80::1%a%b", ":::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8:9", "::ffff:1.2.3.4", "::1.2.3.04", "1.2.3.4", "01.2.3.4", "256.1.1.1", "1.2.3", "g::", "12345::", "1::2::3", "", "host", ":1:2:3:4:5:6:7", "1.2.3.4::", "::1.2.3.4:5", None]
    for _ in range(300):
        groups = [f"{x:x}" for x in rng.choice([0, 0, 1, 0xFC00, 0xFE80, 0xFFFF, 0x2001, 0xDB8, 77], int(rng.integers(6, 10)))]
        texts += [":".join(groups), ":".join(groups[:3]) + "::" + ":".join(groups[4 : rng.integers(4, 8)]), str(ipaddress.IPv6Address(int(rng.integers(1 << 62)) << int(rng.integers(0, 66)))), str(ipaddress.IPv4Address(int(rng.integers(1 << 32))))]
    nets = ["10.0.0.0/8", "0.0.0.0/0", "1.2.3.4/32", "fc00::/7", "::/0", "2001:db8::/32", "::ffff:0:0/96", "172.16.0.0/12", "128.0.0.0/1", "fe80::/10", "no/3", "1.2.3.4/33", "1.2.3.4", "::/129", "9.9.9.9/x"]
    nets += [f"{ipaddress.IPv4Address(int(rng.integers(1 << 32)))}/{rng.integers(1, 25)}" for _ in range(200)]

    def known(t, kind=ipaddress.ip_address):
        try:
            return kind(t.strip("[]") if t.startswith("[") else t)
        except (ValueError, AttributeError):
            return None

    df = spark.createDataFrame(list(enumerate(texts)), "id long, host string").withColumn("address", networks.address(F.col("host")))
    for r in df.collect():
        a = known(r["host"])
        assert r["address"] == (a and "{}{:0{}x}".format(a.version, int(a), a.max_prefixlen // 4)), r
    table = networks.as_networks(spark.createDataFrame([(n, i) for i, n in enumerate(nets)], "cidr string, owner int"))
    real = [(ipaddress.ip_network(n, strict=False), i) for i, n in enumerate(nets) if "/" in n and known(n, lambda x: ipaddress.ip_network(x, strict=False))]
    assert table.count() == len(real)
    want = {}
    for i, t in enumerate(texts):
        a = known(t)
        hits = [(n.prefixlen, -o) for n, o in real if a is not None and a.version == n.version and int(n.network_address) <= int(a) <= int(n.broadcast_address)]
        if hits:
            want[i] = (max(hits)[0], -max(hits)[1])
    got = {r["id"]: (r["net_length"], r["value"]) for r in networks.longest_match(df, table, "id", "address", "owner").collect()}
    assert got == want and len(want) > 200
    assert networks.longest_match(df, table.limit(0), "id", "address", "owner").count() == 0


def test_decoded_hosts_round_trip(spark):
    hosts = ["bücher.example", "例え.テスト", "plain.example", "xn--zz--.example", "xn--hdfc-bnk.example.org", None, "münchen"]
    coded = [h if h is None else h if h.startswith("xn--") else h.encode("idna").decode() for h in hosts]
    got = indicators.decoded_hosts(spark.createDataFrame([(h,) for h in [*coded, "bücher.example"]], "host string")).collect()
    assert [r["host_unicode"] for r in got[:3]] == hosts[:3] and [r["is_idn"] for r in got[:3]] == [True, True, False]
    assert got[3]["host_unicode"] and got[5]["host_unicode"] is None and got[6]["host_unicode"] == "münchen" and got[7]["is_idn"]
    assert indicators.risk_class(spark.createDataFrame([("http://[::1]/",)], "u string"), "u")._jdf.queryExecution().toString().count("ArrowEvalPython") == 0


def test_upserts(spark, tmp_path):
    schema = "k long, t timestamp, rev int, v string"
    of = lambda *rows: spark.createDataFrame([(k, day and datetime.datetime(2024, 1, day), rev, v) for k, day, rev, v in rows], schema)
    path = str(tmp_path / "t")
    first = of((1, 1, 0, "a"), (2, 1, 0, "b"), (3, 2, 0, "c"), (3, 2, 0, "c"), (4, None, None, "n"))
    read = lambda: sorted((r["k"], r["rev"], r["v"]) for r in S.read_upserted(spark, path, first.schema).collect())
    assert read() == []
    for _ in range(2):
        S.upsert_by_date(first, path, ["k"], "t", "rev")
        assert read() == [(1, 0, "a"), (2, 0, "b"), (3, 0, "c"), (4, None, "n")]
    S.upsert_by_date(of((1, 1, 2, "late"), (5, 1, 0, "e")), path, ["k"], "t", "rev")
    S.upsert_by_date(of((1, 1, 1, "too old"), (2, 1, 0, "again")), path, ["k"], "t", "rev")
    assert read() == [(1, 2, "late"), (2, 0, "again"), (3, 0, "c"), (4, None, "n"), (5, 0, "e")]
    assert [x.name for x in (tmp_path / "t" / "data" / "version=4").iterdir() if x.name.startswith("day")] == ["day=2024-01-01"]  # other days stay
    # data without its manifest, as a job that died leaves it, counts for nothing
    of((9, 1, 9, "lost")).withColumn("day", F.lit("2024-01-01")).write.partitionBy("day").parquet(f"{path}/data/version=5")
    assert (1, 2, "late") in read() and len(read()) == 5


def test_seek_pages_are_the_whole_list(spark, tmp_path):
    rows = [(i, i % 7, "x" * (i % 3)) for i in range(103)]
    df = spark.createDataFrame(rows, "id long, at int, text string")
    S.write_clustered(df, str(tmp_path / "p"), [F.desc("at"), F.asc("id")])
    stored, after, seen = spark.read.parquet(str(tmp_path / "p")), None, []
    while page := S.seek_page(stored, [("at", True), ("id", False)], 10, after).collect():
        seen += [r["id"] for r in page]
        after = (page[-1]["at"], page[-1]["id"])
    assert seen == [i for i, at, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    plan = S.seek_page(stored, [("at", True), ("id", False)], 10, (3, 5))._jdf.queryExecution().toString()
    assert "LessThanOrEqual(at,3)" in plan


def test_campaign_steps_do_not_rewrite_all_campaigns(spark, monkeypatch):
    written = []
    monkeypatch.setattr(campaigns, "drop_folder", lambda _, path: written.append(path))
    monkeypatch.setattr(campaigns, "MERGED", 4)
    rows = spark.createDataFrame([("a", i, i, v) for i, v in enumerate(vectors(90))], "family string, id long, at long, v array<double>")
    found, state = campaigns.assign_blocks(rows, campaigns.no_campaigns(spark), block=10)
    assert len(written) == 9 // 4  # nine steps
    sizes = {r["leader"]: r["count"] for r in found.groupBy("leader").count().collect()}
    assert {r["leader"]: r["n"] for r in state.collect()} == sizes  # each campaign once, as it was left last


def test_words_of_a_batch_are_counted_as_one_by_one():
    texts = ["", "  ", " a  b A", "é É\tx\ny", *(" ".join(f"w{i % k}" for i in range(40)) for k in (1, 3, 17))]
    for text, got in zip(texts, campaigns.bucket_counts(texts), strict=True):
        words = [campaigns.word_bucket(w) for w in text.lower().split(" ") if w]
        assert got.tolist() == [words.count(b) for b in range(campaigns.WORD_BUCKETS)]


def test_campaign_vectors_come_with_the_analysis(spark, data, monkeypatch):
    from smishlake.plans import queries

    monkeypatch.setattr(queries.S, "persist_table", lambda df, name, *_: df)
    a = queries._campaign_messages(spark, data)
    assert a._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1  # no text goes to a worker twice
    want = campaigns.word_vectors(scoring.analyze_messages(queries.R.messages(spark, data), parts=("scores",)))
    pair = lambda df: sorted((r["msg_id"], tuple(r["embedding"])) for r in df.select("msg_id", "embedding").collect())
    assert pair(a) == pair(want)


def test_campaign_queries_store_and_scan_only_what_they_need(spark, data, monkeypatch):
    from smishlake.plans import queries

    kept = {}
    monkeypatch.setattr(queries.S, "persist_table", lambda df, name, *_: kept.setdefault(name, df))
    queries._campaign_messages(spark, data)
    assert "raw_text" not in kept["messages-analysed"].columns
    assert "upi_id" not in queries._domains(spark, data)._jdf.queryExecution().optimizedPlan().toString()


def test_indicators_of_texts_that_quick_patterns_let_through(spark):
    texts = ["HTTP://A.example/x", "see WWW.b.example", "Shop.example-one.TOP/a", "a" * 70 + ".com", "me@host.example", "x.y@OKAXIS", "vm-hdfcbk", "10.20.30.40 [::1]", "call 919876543210", "", None]
    m = spark.createDataFrame(list(enumerate(texts)), "msg_id int, raw_text string")
    found = {(r["msg_id"], r["type"]) for r in indicators.extract_indicators(m).collect()}
    assert found == {(0, "url"), (0, "domain"), (1, "url"), (1, "domain"), (2, "url"), (2, "domain"), (3, "url"), (3, "domain"), (4, "email"), (5, "upi_id"), (6, "sender_id"), (7, "ip"), (8, "phone")}
    f = fingerprint.build_fingerprints(scoring.analyze_messages(m.selectExpr("*", "cast(null AS string) AS sender_id", "timestamp_seconds(0) AS received_at")))
    got = {r["msg_id"]: (r["url_count"], r["phone_count"], r["vpa_count"], r["word_count"], r["sentence_count"]) for r in f.collect()}
    assert got[0][0] == got[1][0] == got[2][0] == 1 and got[5][2] == 1 and got[9] == got[10] == (0, 0, 0, 0, 1)
