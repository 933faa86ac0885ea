"""Registered queries of the message analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from smishlake.functions.columns import html_escape
from smishlake.operators import augment, brands, campaigns, conversations, fingerprint, indicators, networks, reports, scoring, text, training, urls
from smishlake.plans import relations as R
from smishlake.sources import tables as S
from smishlake.streaming import jobs

QUERIES: dict = {}
FACTS = ["msg_id", "risk_score", "risk_level", "scam_family", *scoring.PROFILE]


def query(f):
    QUERIES[f.__name__] = f
    return f


def _analyses(spark: SparkSession, d: str, *parts: str, log: bool = False, keep_text: bool = False) -> DataFrame:
    """Messages analysed: the parts that are named, or all."""
    return scoring.analyze_messages(R.messages(spark, d), parts=parts or scoring.PARTS, log=log, keep_text=log or keep_text)


def _scores(spark: SparkSession, d: str, keep_text: bool = False) -> DataFrame:
    return _analyses(spark, d, "scores", keep_text=keep_text)


def _indicators(spark: SparkSession, d: str) -> DataFrame:
    return indicators.extract_indicators(R.messages(spark, d))


# ---- intake ----------------------------------------------------------------------------------------------------------
@query
def intake_rejects(spark, d):
    """Messages over the service limit are rejected with a reason."""
    ok, bad = S.accept_messages(R.messages(spark, d))
    both = ok.withColumn("reason", F.lit("accepted")).unionByName(bad.withColumnRenamed("reject_reason", "reason"))
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("raw_text")).cast("long").alias("longest"))


@query
def intake_conversations(spark, d):
    """Turns escaped and trimmed."""
    c = S.accept_turns(S.read_table(spark, d, "conversations"))
    return c.select("conv_id", "turn", F.sha2(html_escape("text"), 256).alias("escaped_sha256"))


@query
def analysis_lookup(spark, d):
    """Analyses saved by date, and fetched by id for the ids that analysts have labelled."""
    folder = S.new_folder(spark, "analyses")
    S.save_by_date(_scores(spark, d).select(*FACTS, "received_at"), folder, mode="overwrite")
    return S.fetch_all(S.read_any(spark, folder), "msg_id", S.read_table(spark, d, "labels").select(F.col("doc_id").alias("msg_id"))).select(*FACTS)


def _feedback(spark, d) -> DataFrame:
    e = S.read_table(spark, d, "events")
    return e.select(F.col("event_id").cast("string").alias("feedback_id"), F.pmod("event_id", F.lit(997)).cast("string").alias("analysis_id"), F.col("user_id").cast("string").alias("analyst_id"), (F.col("value") > 50).alias("is_correct"), F.col("ts").cast("timestamp").alias("recorded_at"))


@query
def feedback_summary(spark, d):
    """One feedback per analysis and analyst, joined to its analysis."""
    return S.feedback_for(R.messages(spark, d).select(F.col("msg_id").cast("string").alias("analysis_id")), _feedback(spark, d))


@query
def feedback_upserts(spark, d):
    """Feedback merged by key into days: a batch, the same batch again, and corrections of some rows."""
    f = _feedback(spark, d).select("feedback_id", "is_correct", "recorded_at", F.lit(0).alias("revision"))
    folder = S.new_folder(spark, "feedback-by-day")
    late = f.filter(F.pmod(F.col("feedback_id").cast("long"), F.lit(10)) == 0).withColumn("is_correct", ~F.col("is_correct")).withColumn("revision", F.lit(1))
    for batch in (f, f, late):
        S.upsert_by_date(batch, folder, ["feedback_id"], "recorded_at", "revision")
    return S.read_upserted(spark, folder, f.schema).select("feedback_id", "is_correct", "revision")


@query
def messages_seek(spark, d):
    """The third page of the newest messages, found behind the last key of the second, not by an offset."""
    order, folder = [("received_at", True), ("msg_id", True)], S.new_folder(spark, "messages-by-time")
    S.write_clustered(R.messages(spark, d).select("msg_id", "received_at", "source"), folder, [F.desc(c) for c, _ in order])
    stored, after = S.read_any(spark, folder), None
    for _ in range(2):
        last = S.seek_page(stored, order, 20, after).collect()
        after = tuple(last[-1][c] for c, _ in order) if last else after
    return S.seek_page(stored, order, 20, after).select("msg_id", "source")


@query
def key_violations(spark, d):
    """Keys that stand twice or point nowhere, over the tables that are at hand; and texts that stand twice."""
    m, e = R.messages(spark, d), S.read_table(spark, d, "events")
    users = S.read_table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("user_id"))
    tables = {"messages": m, "analyses": S.read_table(spark, d, "labels").select(F.col("doc_id").alias("msg_id")), "conversation_messages": S.read_table(spark, d, "conversations"), "feedback": _feedback(spark, d), "users": users, "audit": e.select("event_id", F.col("user_id").cast("string"))}
    same = S.key_violations(m.select(S.content_hash(F.col("raw_text")).alias("k")), "k").agg(F.lit("messages.text").alias("name"), F.count(F.lit(1)).alias("n"))
    return same.unionByName(S.check_keys(tables))


# ---- text ------------------------------------------------------------------------------------------------------------
@query
def text_normalised(spark, d):
    """Normalised text, number of log entries, confidence."""
    n = text.normalize(R.messages(spark, d), log=False)
    return n.select("msg_id", F.sha2("normalized_text", 256).alias("normalized_sha256"), F.length("normalized_text").cast("long").alias("n_chars"), F.col("n_transformations").cast("long").alias("n_transformations"), F.round("text_confidence", 6).alias("text_confidence"))


@query
def text_truncated(spark, d):
    """What a limit of 5000 characters would leave; the original is kept."""
    m = R.messages(spark, d)
    return m.select("msg_id", F.length(F.substring("raw_text", 1, S.MAX_MESSAGE_CHARS)).cast("long").alias("kept_chars"), F.length("raw_text").cast("long").alias("n_chars"), F.sha2(F.substring("raw_text", 1, S.MAX_MESSAGE_CHARS), 256).alias("kept_sha256"))


@query
def text_log(spark, d):
    """Log entries by type."""
    n = text.normalize(R.messages(spark, d))
    return n.select(F.explode("transformations").alias("t")).groupBy(F.col("t.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query
def text_log_entries(spark, d):
    """The log entries themselves, before and after, and how often each stands in the log of a message."""
    n = text.normalize(R.messages(spark, d))
    return n.select(F.explode("transformations").alias("t")).groupBy("t.type", "t.original", "t.transformed").agg(F.count(F.lit(1)).alias("n"))


@query
def lang_script(spark, d):
    """Languages and scripts of the normalised texts."""
    n = text.normalize(R.messages(spark, d), log=False, keep_text=False)
    return n.groupBy("language", F.array_join("scripts", ",").alias("scripts")).agg(F.count(F.lit(1)).alias("n"))


# ---- indicators ------------------------------------------------------------------------------------------------------
@query
def ioc_all(spark, d):
    """Every indicator of every message."""
    return _indicators(spark, d).select("msg_id", "type", "value", "confidence", "ssrf_risk", "is_internal", "is_idn")


@query
def ioc_email_ipv4_counts(spark, d):
    """I3, I6 on the documents as they are."""
    docs = S.read_table(spark, d, "documents").select(F.col("doc_id").alias("msg_id"), F.col("text").alias("raw_text"))
    found = indicators.extract_indicators(docs, ("ip", "email"))
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_values"))


@query
def ioc_threat_report(spark, d):
    """Counts per message."""
    return indicators.threat_report(_indicators(spark, d))


def _down():
    raise ConnectionError("this provider never answers")


def _verdicts(spark, found):
    """Two providers that answer, and one that fails between them."""
    local = indicators.blocklist(spark)
    payments = local.filter("kind = 'upi_id'").withColumn("reputation_score", F.lit(0.03))
    return indicators.enrich_all(found, {"local": local, "down": _down, "payments": lambda: payments})


@query
def ioc_blocklist(spark, d):
    """Verdicts of several providers; one that fails is skipped."""
    return _verdicts(spark, _indicators(spark, d))


@query
def ioc_top_values(spark, d):
    """Most frequent indicators, and how many verdicts there are on each."""
    found = S.persist_table(_indicators(spark, d), "indicators")  # read by the roll-up and by every provider
    return reports.top_indicators(indicators.roll_up(found, _verdicts(spark, found)), 20).select("type", "value", "n", "confidence", "n_messages", "enrichment_count")


@query
def ioc_safe_urls(spark, d):
    """URLs that may be enriched."""
    return reports.of_type(indicators.safe_only(_indicators(spark, d)), "url").groupBy("host").agg(F.count(F.lit(1)).alias("n"))


@query
def url_hosts(spark, d):
    """Host of every URL, whether it is internationalised, and what it says decoded."""
    u = R.page_urls(spark, d).withColumn("host", indicators.host_of(F.col("url")))
    return indicators.decoded_hosts(u).select("url_id", "host", "is_idn", "host_unicode")


@query
def ip_risk_class(spark, d):
    """Address class of every URL."""
    return indicators.risk_class(R.page_urls(spark, d), "url").select("url_id", "ssrf_risk")


@query
def network_owners(spark, d):
    """The longest network that holds the address of each event, of networks of any number."""
    found = networks.longest_match(R.event_addresses(spark, d), networks.as_networks(R.customer_networks(spark, d)), "event_id", "address", "owner")
    return found.select("event_id", "net_length", F.col("value").alias("owner"))


# ---- URL findings ----------------------------------------------------------------------------------------------------
@query
def url_findings(spark, d):
    """One row per finding."""
    u = urls.url_findings(R.page_urls(spark, d))
    return u.select("url_id", F.explode("findings").alias("f")).select("url_id", "f.finding_id", "f.severity", "f.confidence", F.coalesce("f.detail", F.lit("")).alias("detail"))


@query
def url_verdicts(spark, d):
    """U16: verdict of each URL."""
    return urls.url_findings(R.page_urls(spark, d)).select("url_id", "is_malicious", "confidence", F.col("n_findings").cast("long").alias("n_findings"))


@query
def url_entropy(spark, d):
    """Shannon entropy of host, path and query."""
    return urls.url_findings(R.page_urls(spark, d)).select("url_id", F.round("url_entropy", 4).alias("entropy"))


# ---- evidence, brands, scores ----------------------------------------------------------------------------------------
@query
def evidence_long(spark, d):
    """Every piece of evidence."""
    a = _analyses(spark, d)
    return a.select("msg_id", F.explode("evidence").alias("e")).select("msg_id", "e.category", "e.severity", "e.confidence", "e.value")


@query
def evidence_risk(spark, d):
    """Risk, tier, category, confidence."""
    return _analyses(spark, d).select("msg_id", "evidence_risk", "evidence_tier", "evidence_category", F.round("evidence_confidence", 2).alias("evidence_confidence"))


@query
def brand_decisions(spark, d):
    """Claimed brand, decision and reference of each message."""
    return _analyses(spark, d, "brands").select("msg_id", F.coalesce("claimed_brand", F.lit("")).alias("brand"), "impersonation_detected", "brand_confidence", "has_official_link", "has_phishing_link", "sender_mismatch", F.coalesce("reference.category", F.lit("")).alias("ref_category"), F.coalesce("reference.support_url", F.lit("")).alias("ref_support_url"), F.coalesce(F.array_join("reference.domains", ","), F.lit("")).alias("ref_domains"))


@query
def brand_lookup(spark, d):
    """Registry by alias in a text, and by domain of a URL."""
    m = brands.find_by_alias(R.messages(spark, d).select("msg_id", "raw_text"), "raw_text").groupBy(F.lit("alias").alias("kind"), F.coalesce("org_id", F.lit("")).alias("org_id")).agg(F.count(F.lit(1)).alias("n"))
    u = R.page_urls(spark, d).select("url_id", indicators.host_of(F.col("url")).alias("host"))
    u = brands.find_by_domain(u, "host").groupBy(F.lit("domain").alias("kind"), F.coalesce("org_id", F.lit("")).alias("org_id")).agg(F.count(F.lit(1)).alias("n"))
    return m.unionByName(u)


@query
def manipulation(spark, d):
    """Profile, family, risk and level of each message."""
    return _scores(spark, d).select(*FACTS)


@query
def recommended_actions(spark, d):
    """Actions, and how many distinct trigger words stand in the texts."""
    a = scoring.trigger_words(_scores(spark, d))
    return a.groupBy("recommended_action").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("facts.words")).alias("n_words"), F.sum(F.size("facts.links")).alias("n_links"))


@query
def decoded_meanings(spark, d):
    """What the messages try to do, in words."""
    return _scores(spark, d).groupBy("decoded_meaning", "recommended_action").agg(F.count(F.lit(1)).alias("n"))


@query
def message_records(spark, d):
    """The wide row of every message: scores, language, brand, stage, next step, fingerprint, counts of indicators."""
    a = _analyses(spark, d, log=True)
    counts = indicators.threat_report(_indicators(spark, d))
    stages = conversations.single_messages(R.messages(spark, d))
    results = S.persist_table(conversations.conversation_results(stages), "message-stages")
    none = conversations.transitions(stages, conversations.stage_graph(spark)).limit(0)
    steps = conversations.predict_next_step(results, none, conversations.stage_actions(spark))
    steps = steps.select(F.col("conv_id").alias("msg_id"), F.col("action").alias("next_step"), "probability")
    stage = results.select(F.col("conv_id").alias("msg_id"), F.col("current_state").alias("stage"), F.col("overall_confidence").alias("stage_confidence"))
    f = fingerprint.build_fingerprints(a)
    f = f.select("msg_id", "language", "scam_family", "risk_score", "evidence_tier", F.coalesce("claimed_brand", F.lit("")).alias("brand"), "impersonation_detected", "org", "message_structure", "hour_bucket", "dna_hash")
    wide = f.join(stage.hint("merge"), "msg_id").join(steps.hint("merge"), "msg_id", "left").join(counts.select("msg_id", "n_url", "n_phone", "n_suspicious").hint("merge"), "msg_id", "left")
    return wide.fillna(0, ["n_url", "n_phone", "n_suspicious"]).fillna("", ["next_step"]).fillna(0.0, ["probability"])


@query
def family_risk(spark, d):
    """X9, G1, flagship: families and levels."""
    return reports.risk_levels(_scores(spark, d))


# ---- analyst queries ---------------------------------------------------------------------------------------------------
@query
def overview(spark, d):
    """G1: totals."""
    return reports.overview(_scores(spark, d))


@query
def family_language_sets(spark, d):
    """G1: histograms with grouping sets."""
    return reports.histograms(_scores(spark, d))


@query
def messages_page(spark, d):
    """Second page of a family, newest first, without text."""
    a = reports.without_text(_scores(spark, d))
    return reports.messages_page(a, "bank_kyc", 35, limit=20, offset=20).select("msg_id", "scam_family", "risk_score")


@query
def redacted_documents(spark, d):
    """V3: secrets out of the documents."""
    docs = S.read_table(spark, d, "documents")
    return docs.select("doc_id", F.sha2(reports.redact(F.col("text")), 256).alias("redacted_sha256"), (reports.redact(F.col("text")) != F.col("text")).alias("changed"))


@query
def retention_scrub(spark, d):
    """V2, V4: text and sender of old messages become null, hashes stay."""
    m = R.messages(spark, d).withColumn("content_hash", S.content_hash(F.col("raw_text")))
    old = reports.scrub_old(m, F.timestamp_seconds(F.lit(1704067200 + 500 * 60)))
    return old.select("msg_id", "content_hash", F.col("raw_text").isNull().alias("scrubbed"), F.coalesce("sender_id", F.lit("-")).alias("sender"))


# ---- fingerprints ------------------------------------------------------------------------------------------------------
@query
def dna_traits(spark, d):
    """Structural traits."""
    f = fingerprint.build_fingerprints(_analyses(spark, d, "scores", log=True))
    return f.select("msg_id", F.col("word_count").cast("long").alias("word_count"), F.col("sentence_count").cast("long").alias("sentence_count"), "has_imperatives", "org", F.col("url_count").cast("long").alias("url_count"), F.array_join("tlds", ",").alias("tlds"), "is_shortener", "has_homoglyph", F.col("phone_count").cast("long").alias("phone_count"), F.array_join("psp_handles", ",").alias("psp"), F.array_join("currencies", ",").alias("currencies"), "message_structure", "dna_language", "dna_script", "hour_bucket")


@query
def dna_hash(spark, d):
    """Fingerprint hashes and how many messages have them."""
    f = fingerprint.build_fingerprints(_analyses(spark, d, "scores", log=True))
    return f.groupBy("dna_hash").agg(F.count(F.lit(1)).alias("n"), F.min("scam_family").alias("scam_family"))


@query
def dna_pairs_topk(spark, d):
    """Most similar partners of each message among those that share an entity or a fingerprint."""
    a = campaigns.word_vectors(_analyses(spark, d, "scores", log=True))
    return fingerprint.top_partners(fingerprint.build_fingerprints(a, _indicators(spark, d)), 3).select("id_a", "id_b", "composite", "association", "rank")


@query
def embedding_pairs(spark, d):
    """Pairs of vectors of one label with cosine 0.4 or more."""
    pairs = campaigns.near_pairs(R.vectors(spark, d), 0.40, "vec_id", group_col="label")
    return pairs.select("id_a", "id_b", F.round("cosine", 6).alias("cosine"))


# ---- campaigns ---------------------------------------------------------------------------------------------------------
@query
def embedding_validation(spark, d):
    """Valid vectors per label."""
    return R.vectors(spark, d).groupBy("label").agg(F.count_if(campaigns.valid_vector(F.col("embedding"), 64)).alias("n_valid"), F.count(F.lit(1)).alias("n"))


@query
def label_centroids(spark, d):
    """Unit centroid of each label, as its first and largest components."""
    c = campaigns.centroids(R.vectors(spark, d), "label")
    return c.select("label", "n", F.round(F.get("centroid", F.lit(0)), 6).alias("first"), F.round(F.array_max("centroid"), 6).alias("largest"))


@query
def exact_duplicates(spark, d):
    """Copies belong to the first message with their text."""
    return campaigns.exact_duplicates(R.messages(spark, d)).select("msg_id", "first_id", "n_copies", "is_duplicate")


def _campaign_messages(spark, d) -> DataFrame:
    """Analysed messages with word vectors, stored; of the texts only their hashes."""
    kept = ["msg_id", S.content_hash(F.col("raw_text")).alias("content_hash"), "scam_family", "received_at", "sender_id", "language", "risk_score", "embedding"]
    a = scoring.analyze_messages(R.messages(spark, d), parts=("scores",), log=False, keep_text=False, vectors=campaigns.unit_counts)
    return S.persist_table(a.select(*kept), "messages-analysed")


def _assigned_with_centroids(spark, d) -> tuple[DataFrame, DataFrame]:
    """Messages with the campaigns that they were assigned to, and the centroids of these."""
    a = _campaign_messages(spark, d)
    members, centroid = campaigns.assign_with_centroids(a)
    return a.drop("content_hash").join(S.persist_table(members, "campaign-members").hint("merge"), "msg_id"), centroid


def _assigned(spark, d) -> DataFrame:
    return _assigned_with_centroids(spark, d)[0]


def _domains(spark, d) -> DataFrame:
    return indicators.domains(R.messages(spark, d)).select("msg_id", "value")


@query
def campaign_assignment(spark, d):
    """Each message opens a campaign, joins the best of its family, or is a copy."""
    return _assigned(spark, d).select("msg_id", "campaign_id", "similarity", "confidence", "is_new", "is_duplicate")


@query
def campaign_stream(spark, d):
    """The same assignment by a stream to which the messages come in four deliveries, in the order of time."""
    a = _campaign_messages(spark, d)
    folder = S.new_folder(spark, "campaign-stream")
    span = a.agg(F.min("received_at").alias("a"), F.max("received_at").alias("b")).first()
    part = F.least(F.lit(3), F.floor((F.unix_micros("received_at") - F.unix_micros(F.lit(span["a"]))) * 4 / F.greatest(F.lit(1), F.unix_micros(F.lit(span["b"])) - F.unix_micros(F.lit(span["a"])))))
    for k in range(4):
        a.filter(part == k).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(a.schema).parquet(f"{folder}/in")
        jobs.assign_campaigns(stream, folder).trigger(availableNow=True).start().awaitTermination()
    return jobs.read_assigned(spark, folder)


@query
def campaign_store(spark, d):
    """The campaigns written with their members, and read back."""
    folder = S.new_folder(spark, "campaign-store")
    members, centroid = _assigned_with_centroids(spark, d)
    campaigns.write_campaigns(members, folder, _domains(spark, d), centroid)
    members = S.read_any(spark, f"{folder}/campaign_members").groupBy("campaign_id").agg(F.count(F.lit(1)).alias("n_stored"), F.round(F.sum("confidence"), 2).alias("sum_confidence"))
    c = S.read_any(spark, f"{folder}/campaigns").join(members.hint("merge"), "campaign_id")
    return c.select("campaign_id", "scam_family", "member_count", "n_stored", "sum_confidence", F.unix_timestamp("first_seen").alias("first_seen"), F.unix_timestamp("last_seen").alias("last_seen"), F.array_join("domains", ",").alias("domains"), F.array_join("senders", ",").alias("senders"), F.round(F.array_max("centroid"), 6).alias("largest"), "status")


def _members(spark, d) -> DataFrame:
    """Members of the assigned campaigns; copies do not count again."""
    return _assigned(spark, d).filter("NOT is_duplicate")


@query
def campaign_summary(spark, d):
    """Details of campaigns."""
    m = _members(spark, d)
    s = campaigns.with_top_domains(campaigns.campaign_summaries(m), campaigns.campaign_domains(m, _domains(spark, d)), campaigns.DOMAINS_DETAILED)
    return s.select("campaign_id", F.array_join("top_domains", ",").alias("top_domains"), "member_count", "scam_family", F.unix_timestamp("first_seen").alias("first_seen"), F.unix_timestamp("last_seen").alias("last_seen"), "confidence", "avg_risk", "dominant_language", F.array_join(F.transform(F.map_entries("languages"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("languages"))


@query
def campaign_list(spark, d):
    """C11: a page of campaigns, last seen first."""
    m = _members(spark, d)
    s = campaigns.with_top_domains(campaigns.campaign_summaries(m), campaigns.campaign_domains(m, _domains(spark, d)), campaigns.DOMAINS_LISTED)
    return campaigns.list_campaigns(s, 10, 5).select("campaign_id", F.unix_timestamp("last_seen").alias("last_seen"), "member_count", F.array_join("top_domains", ",").alias("top_domains"))


@query
def campaign_senders(spark, d):
    """First distinct senders of each campaign."""
    m = _members(spark, d).withColumn("sender_id", F.nullif("sender_id", F.lit("")))
    return campaigns.first_distinct(m, "sender_id", campaigns.SENDERS_KEPT, campaigns.SENDERS_OPENED).select("campaign_id", F.array_join("values", ",").alias("senders"))


@query
def campaign_members(spark, d):
    """A page of the members of the largest campaign, without text."""
    m = S.persist_table(_members(spark, d).select("campaign_id", "msg_id", "received_at", "risk_score", "similarity"), "campaign-page")
    largest = m.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "campaign_id").first()
    return campaigns.members_page(m, largest["campaign_id"] if largest else "", 20, 5).select("campaign_id", "msg_id", "risk_score", "similarity")


@query
def cluster_purity(spark, d):
    """Share of the messages of each family that lie in its largest campaign."""
    return campaigns.purity(_members(spark, d), "scam_family").select(F.round("purity", 6).alias("purity"), "families")


# ---- conversations -----------------------------------------------------------------------------------------------------
@query
def conv_stages(spark, d):
    """M1-M5: stage of each message."""
    return conversations.staged(R.conversation_messages(spark, d)).select("conv_id", F.col("idx").cast("long").alias("idx"), "turn", "state", "state_confidence", F.round("benign", 6).alias("benign"), F.array_join("signals", ",").alias("signals"))


@query
def conv_repeats(spark, d):
    """M2: repeated messages, on the conversations as they are."""
    c = conversations.order_messages(S.read_table(spark, d, "conversations"))
    return conversations.drop_repeats(c).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_kept"), F.max("n_repeats").alias("n_repeats"))


@query
def conv_transitions(spark, d):
    """M6: changes of stage."""
    t = conversations.transitions(conversations.staged(R.conversation_messages(spark, d)), conversations.stage_graph(spark))
    return t.select("conv_id", F.col("idx").cast("long").alias("idx"), "from_state", "to_state", "confidence", "valid", "trigger")


@query
def conv_results(spark, d):
    """One row per conversation."""
    r = conversations.conversation_results(conversations.staged(R.conversation_messages(spark, d)))
    return r.select("conv_id", "message_count", "current_state", F.array_join("previous_states", ",").alias("previous_states"), "overall_confidence", "advancement", "is_progression", F.coalesce("likely_next_state", F.lit("")).alias("likely_next_state"), F.array_join("warnings", ",").alias("warnings"))


@query
def next_step(spark, d):
    """Predicted next action."""
    s = conversations.staged(R.conversation_messages(spark, d))
    n = conversations.predict_next_step(conversations.conversation_results(s), conversations.transitions(s, conversations.stage_graph(spark)), conversations.stage_actions(spark))
    return n.select("conv_id", "current_state", "action", "probability", "uncertainty", "abstained", F.array_join("evidence", ",").alias("evidence"))


# ---- augmentation ------------------------------------------------------------------------------------------------------
@query
def augment_fixed(spark, d):
    """Variants without chance."""
    v = augment.augment_messages(R.messages(spark, d), augment.FIXED)
    return v.select("msg_id", "perturbation", F.sha2("raw_text", 256).alias("variant_sha256"))


@query
def augment_random(spark, d):
    """Seeded variants."""
    v = augment.augment_messages(R.messages(spark, d), augment.RANDOM)
    return v.select("msg_id", "perturbation", F.sha2("raw_text", 256).alias("variant_sha256"))


def _variants(spark, d, kinds=augment.FIXED, keep_text=False):
    """Scored variants of all messages, one a perturbation."""
    return augment.scored_variants(R.messages(spark, d), kinds, keep_text=keep_text)


@query
def robustness(spark, d):
    """Detection rates per perturbation, drawn ones too, and language."""
    return augment.robustness(_variants(spark, d, augment.PERTURBATIONS))


@query
def hardest_five(spark, d):
    """P25: the five variants with the least risk."""
    return augment.hardest(_variants(spark, d)).select("msg_id", "perturbation", "risk_score")


@query
def undetected(spark, d):
    """P25: distinct undetected variants per perturbation, escaped, and the first of them."""
    return augment.failures(_variants(spark, d, keep_text=True)).groupBy("perturbation").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.min("escaped"), 256).alias("first_sha256"))


# ---- training ----------------------------------------------------------------------------------------------------------
@query
def template_groups(spark, d):
    """groups of texts that differ in white space or case."""
    return training.template_groups(S.read_table(spark, d, "documents"))


@query
def split_by_template(spark, d):
    """split of each document."""
    return training.leakage_free_split(S.read_table(spark, d, "documents")).select("doc_id", "split")


@query
def split_overlap(spark, d):
    """templates per split, and how many lie in two splits."""
    s = training.leakage_free_split(S.read_table(spark, d, "documents"))
    sizes = s.groupBy("split").agg(F.count_distinct("template").alias("n"))
    return sizes.unionByName(training.split_overlap(s).agg(F.lit("overlap").alias("split"), F.count(F.lit(1)).alias("n")))


@query
def calibrated(spark, d):
    """calibration of a scored table; the scores are the normalised profile."""
    a = _scores(spark, d, keep_text=True)
    names = F.array(*map(F.lit, scoring.PROFILE))
    p = F.array(*scoring.PROFILE)
    a = a.withColumn("probability", F.col("risk_score") / 100).withColumn("label", F.col("scam_family")).withColumn("strongest", training.arg_max(p, names))
    c = training.calibrate(a)
    return c.select("msg_id", F.round("final_confidence", 6).alias("final_confidence"), F.round("risk", 6).alias("risk"), "family", "level", "is_low_confidence", "strongest")


def _judged(spark, d):
    """Languages of the documents as labels, and what the language rule (T15) says of their messages as predictions."""
    found = text.normalize(R.messages(spark, d), log=False, keep_text=False).select(F.col("msg_id").alias("doc_id"), F.col("language").alias("predicted"))
    return S.read_table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("label")).join(found.hint("merge"), "doc_id").select("label", "predicted")


@query
def confusion_matrix(spark, d):
    """counts by label and prediction."""
    return training.confusion(_judged(spark, d))


@query
def macro_f1(spark, d):
    """accuracy and macro scores over all classes that are labelled or predicted."""
    m = training.overall_metrics(training.class_metrics(_judged(spark, d)))
    return m.select(*(F.round(c, 6).alias(c) for c in m.columns))


@query
def classifier_scores(spark, d):
    """a classifier of the language of documents, trained on the train split and measured on the rest."""
    s = training.leakage_free_split(S.read_table(spark, d, "documents").filter("text IS NOT NULL AND lang IS NOT NULL")).withColumnRenamed("lang", "label")
    model = training.train_classifier(s.filter("split = 'train'").select("text", "label"), features=1 << 12)
    judged = training.predict(model, s.filter("split <> 'train'").select("split", "text", "label"))
    return judged.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("predicted")).cast("int")).alias("accuracy"))
