"""Stages of conversations, their transitions and the likely next step. One shuffle on conv_id carries it all."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from smishlake.functions import constants as C
from smishlake.functions.columns import barrier, half_even, html_escape
from smishlake.functions.scan import Detector, Scanner
from smishlake.operators.text import in_slices, in_small_batches

NAMES = [s[0] for s in C.STAGES]
LEAST_SCORE, PER_MATCH, DAMPING, EDGE_BONUS = 0.15, 0.35, 0.35, 0.10
NEXT_LEAST, ABSTAIN_BELOW, PROGRESS_LEAST = 0.30, 0.28, 0.30


def stage_graph(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(C.STAGE_GRAPH), T.StructType.fromDDL("from_state string, to_state string"))


def stage_actions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, a, p, i) for i, (s, a, p) in enumerate(C.STAGE_ACTIONS)], T.StructType.fromDDL("state string, action string, base double, ord int"))


def order_messages(df: DataFrame) -> DataFrame:
    """Adds pos (order in the conversation) and time_reversed. With a ts column, known times sort after unknown ones."""
    by_turn = Window.partitionBy("conv_id").orderBy("turn")
    if "ts" not in df.columns:
        return df.withColumn("pos", F.row_number().over(by_turn)).withColumn("time_reversed", F.lit(False))
    last = F.max("ts").over(by_turn.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("time_reversed", F.coalesce(F.col("ts") < last, F.lit(False)))
    return df.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("ts").asc_nulls_first(), "turn")))


def drop_repeats(df: DataFrame) -> DataFrame:
    """Keeps the first of equal texts of a conversation; adds n_repeats of the conversation."""
    h = F.sha2(F.col("text"), 256)
    same = Window.partitionBy("conv_id", h).orderBy("pos")
    whole = Window.partitionBy("conv_id")
    df = df.withColumn("_r", F.row_number().over(same))
    return df.withColumn("n_repeats", F.count_if(F.col("_r") > 1).over(whole)).filter("_r = 1").drop("_r")


#: Matches of the pattern of each stage, and of benign context. Built without a session: workers import this module.
COUNTS = T.StructType([T.StructField(n, T.IntegerType()) for n in (*NAMES, "BENIGN")])


@lru_cache(maxsize=1)
def _scanner() -> Scanner:
    latin = [Detector(name, p, "count", True) for name, p, _ in C.STAGES]
    deva = [Detector(name, p, "count") for name, _, p in C.STAGES if p]
    return Scanner([*latin, Detector("BENIGN", C.BENIGN, "count", True), *deva])


def pattern_counts(text: str) -> tuple[int, ...]:
    """COUNTS of a text: words of each stage and of benign context, and terms of Devanagari stages without word boundaries."""
    out = dict.fromkeys(COUNTS.names, 0)
    for detector, n in zip(_scanner().detectors, _scanner().scan(text.lower()), strict=True):
        out[detector.name] += n
    return tuple(out.values())


@F.arrow_udf(COUNTS)
def _counts(texts: pa.Array) -> pa.Array:
    return in_slices(pattern_counts, COUNTS, texts)


def assign_stages(df: DataFrame) -> DataFrame:
    """Adds scores (struct by stage), benign, state, state_confidence and signals to rows with text.

    All patterns are counted in one Arrow pass by an automaton of the words that they begin with."""
    df = barrier(in_small_batches(df).withColumn("_n", _counts("text")), "_n")
    for name in NAMES:
        df = df.withColumn(f"s_{name}", F.least(F.lit(1.0), PER_MATCH * F.col(f"_n.{name}")))
    df = df.withColumn("benign", F.least(F.lit(1.0), PER_MATCH * F.col("_n.BENIGN"))).drop("_n")
    best = F.array_max(F.array(*(F.struct(F.col(f"s_{n}").alias("score"), F.lit(-i).alias("ord"), F.lit(n).alias("name")) for i, n in enumerate(NAMES))))
    df = df.withColumn("_best", best)
    named = F.col("_best.score") > LEAST_SCORE
    df = df.withColumn("state", F.when(named, F.col("_best.name")).otherwise("UNKNOWN"))
    score = F.when(named, F.col("_best.score")).otherwise(LEAST_SCORE)
    df = df.withColumn("state_confidence", half_even(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score * (1 - DAMPING * F.col("benign")))), 3))
    signals = [F.when(F.col(f"s_{n}") > 0.10, F.concat(F.lit("signal_"), F.lower(F.lit(n)))) for n in NAMES] + [F.when(F.col("benign") > 0.2, F.lit("signal_benign_context"))]
    return barrier(df.withColumn("signals", F.array_compact(F.array(*signals))).drop("_best"))


def staged(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text[, ts]) escaped, ordered, without repeats, with stages; idx counts from 0."""
    df = conversations.withColumn("text", html_escape(F.coalesce("text", F.lit(""))))
    df = assign_stages(drop_repeats(order_messages(df)))
    return df.withColumn("idx", F.row_number().over(Window.partitionBy("conv_id").orderBy("pos")) - 1)


def single_messages(messages: DataFrame) -> DataFrame:
    """Stages of messages(msg_id, raw_text) that belong to no conversation: each is one of its own. A projection."""
    one = messages.select(F.col("msg_id").alias("conv_id"), html_escape(F.coalesce("raw_text", F.lit(""))).alias("text"))
    staged_ = assign_stages(one).drop("text")
    return staged_.withColumn("idx", F.lit(0)).withColumn("n_repeats", F.lit(0).cast("long")).withColumn("time_reversed", F.lit(False))


def transitions(stages: DataFrame, graph: DataFrame) -> DataFrame:
    """Changes of stage between neighbours, unknown ones left out; an edge of the graph adds to the confidence."""
    w = Window.partitionBy("conv_id").orderBy("idx")
    prev = stages.withColumn("_p", F.lag(F.struct("state", "state_confidence")).over(w))
    moved = prev.filter((F.col("_p.state") != F.col("state")) & (F.col("_p.state") != "UNKNOWN") & (F.col("state") != "UNKNOWN"))
    moved = moved.select("conv_id", "idx", F.col("_p.state").alias("from_state"), F.col("state").alias("to_state"), ((F.col("_p.state_confidence") + F.col("state_confidence")) / 2).alias("_c"), F.coalesce(F.get("signals", F.lit(0)), F.lit("unknown_signal")).alias("trigger"))
    known = moved.join(F.broadcast(graph.withColumn("valid", F.lit(True))), ["from_state", "to_state"], "left")
    confidence = F.when(F.col("valid"), F.least(F.lit(1.0), F.col("_c") + EDGE_BONUS)).otherwise(F.col("_c"))
    return known.select("conv_id", "idx", "from_state", "to_state", half_even(confidence, 3).alias("confidence"), F.coalesce("valid", F.lit(False)).alias("valid"), "trigger")


def conversation_results(stages: DataFrame) -> DataFrame:
    """One row per conversation: size, current and earlier states, confidence, advancement, progression, next stage, warnings."""
    order = F.when(F.col("state").isin(*NAMES[:-1]), F.element_at(F.create_map(*(x for i, n in enumerate(NAMES[:-1]) for x in (F.lit(n), F.lit(i)))), F.col("state")))
    out = stages.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("message_count"),
        F.max_by("state", "idx").alias("current_state"),
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "state"))), lambda x: x["state"]).alias("_all"),
        F.avg("state_confidence").alias("_conf"),
        F.coalesce(F.max(order), F.lit(0)).alias("_far"),
        F.count_distinct(F.when((F.col("state") != "UNKNOWN") & (F.col("state_confidence") >= PROGRESS_LEAST), F.col("state"))).alias("_kinds"),
        F.max("n_repeats").alias("n_repeats"),
        F.max("time_reversed").alias("time_reversed"),
        *(F.max_by(f"s_{n}", "idx").alias(f"last_{n}") for n in ("CREDENTIAL_REQUEST", "PAYMENT_REQUEST", "REMOTE_ACCESS")),
    )
    out = out.withColumn("previous_states", F.slice("_all", F.lit(1), F.size("_all") - 1)).withColumn("overall_confidence", half_even(F.col("_conf"), 3))
    out = out.withColumn("advancement", half_even(F.col("_far") / (len(NAMES) - 1), 3)).withColumn("is_progression", F.col("_kinds") >= 2)
    following = F.create_map(*(F.lit(x) for pair in zip(NAMES, NAMES[1:], strict=False) for x in pair))
    likely = F.when((F.col("_conf") >= NEXT_LEAST) & (F.col("current_state") != "UNKNOWN"), F.try_element_at(following, F.col("current_state")))
    warnings = F.array_compact(F.array(F.when(F.col("time_reversed"), F.lit("TIME_REVERSED")), F.when(F.col("n_repeats") > 0, F.lit("REPEATED_MESSAGES"))))
    return out.withColumn("likely_next_state", likely).withColumn("warnings", warnings).drop("_all", "_conf", "_far", "_kinds")


def predict_next_step(results: DataFrame, moves: DataFrame, actions: DataFrame) -> DataFrame:
    """conv_id, action, probability, uncertainty, abstained, evidence: the best action of the current stage.

    Actions are a fixed dimension. Too little confidence or an unknown stage abstains.
    """
    n = moves.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_moves"), F.max_by(F.concat_ws(">", "from_state", "to_state"), "idx").alias("last_move"))
    df = results.join(n.hint("merge"), "conv_id", "left").withColumn("n_moves", F.coalesce("n_moves", F.lit(0)))
    df = df.join(F.broadcast(actions.withColumnRenamed("state", "current_state")), "current_state")
    signal = F.when(F.col("action") == "REQUEST_OTP", F.col("last_CREDENTIAL_REQUEST")).when(F.col("action") == "REQUEST_UPI_PAYMENT", F.col("last_PAYMENT_REQUEST")).when(F.col("action") == "REQUEST_REMOTE_ACCESS", F.col("last_REMOTE_ACCESS")).otherwise(0.0)
    boost = 0.05 * F.least("n_moves", F.lit(3)) + F.when(F.col("is_progression"), 0.08).otherwise(0.0) + F.when(signal > 0.2, signal * 0.25).otherwise(0.0)
    df = df.withColumn("p", F.least(F.lit(1.0), F.col("base") + boost))
    best = df.groupBy("conv_id").agg(F.min(F.struct((-F.col("p")).alias("neg"), "ord", "action", "overall_confidence", "advancement", "current_state", "last_move")).alias("b"))
    abstained = (F.col("b.overall_confidence") < ABSTAIN_BELOW) | (F.col("b.current_state") == "UNKNOWN")
    calibrated = F.least(F.lit(1.0), -F.col("b.neg") * (0.8 + 0.2 * F.col("b.advancement")) * F.col("b.overall_confidence"))
    out = best.select("conv_id", F.col("b.current_state").alias("current_state"), F.when(abstained, "NEEDS_REVIEW").otherwise(F.col("b.action")).alias("action"), half_even(F.when(abstained, F.col("b.overall_confidence")).otherwise(calibrated), 3).alias("probability"), abstained.alias("abstained"), F.array_compact(F.array(F.col("b.last_move"))).alias("evidence"))
    return out.withColumn("uncertainty", half_even(1 - F.col("probability"), 3))
