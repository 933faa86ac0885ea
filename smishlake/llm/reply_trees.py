"""Operator 5: chat formatting of reply trees. DataFrame functions only.

Messages point to the message they answer. Iterative self-joins, each reaching twice as far as the one before, sum scores
from the roots to the leaves; each leaf ends a branch. Branches are ranked by score within their tree, the same jumps list
the messages of the chosen ones, and these are formatted, texts joined at the end.

Template of one message: <|im_start|>ROLE<|im_sep|>TEXT<|im_end|> and a line feed. Inside roles and texts a backslash
becomes two, and `<|` becomes `<\\|`, so no control string can occur there and unescaping gives the text back. Beside the
formatted text stand its segments, each with the loss mask: true for the text of an assistant, false for all else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from smishlake.llm.common import store, table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: The role whose texts the loss counts.
LEARNED = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def segments(role: Column, text: Column) -> Column:
    """The three stretches of a formatted message with their loss mask; together they are the message."""
    part = lambda c, loss: F.struct(c.alias("text"), loss.alias("loss"))
    return F.array(part(F.concat(F.lit(START), escape(role), F.lit(SEP)), F.lit(False)), part(escape(text), role == LEARNED), part(F.lit(END), F.lit(False)))


def climb(messages: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Self-joins that double their reach: (totals, leaves, jumps).

    messages(tree_id, msg_id, parent_id, score): a message whose parent_id is null or names no message of its tree is a
    root. totals has the score sum and the number of messages from the root to each message; jumps[k] leads from a
    message to the one 2**k above it. A tree of depth d takes about log2(d) rounds; ids and sums are carried, no texts.
    tree_id must not be null. Repeated (tree_id, msg_id) rows must be settled before. Messages on or under a cycle have no root and are left out.
    """
    m = store(messages.select("tree_id", "msg_id", "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "reply-edges")
    ids = m.select("tree_id", F.col("msg_id").alias("parent_id"), F.lit(True).alias("known"))
    start = m.join(ids.hint("merge"), ["tree_id", "parent_id"], "left")
    rows = store(start.select("tree_id", "msg_id", F.when(F.col("known"), F.col("parent_id")).alias("up"), "score", F.lit(1).cast("long").alias("n")), "reply-rows")
    parents = rows.filter("up IS NOT NULL").select("tree_id", F.col("up").alias("msg_id")).distinct()
    leaves = rows.join(parents.hint("merge"), ["tree_id", "msg_id"], "left_anti").select("tree_id", "msg_id")
    jumps, ended, most = [], [rows.filter("up IS NULL")], rows.count()
    while not (open_ := rows.filter("up IS NOT NULL")).isEmpty() and 1 << len(jumps) <= most:
        jumps.append(open_.select("tree_id", "msg_id", "up"))
        # messages that have reached their root stay as they are; only the others are joined on
        above = open_
        for e in ended:
            above = above.unionByName(e)
        above = above.select("tree_id", F.col("msg_id").alias("up"), F.col("up").alias("next"), F.col("score").alias("more"), F.col("n").alias("m"))
        rows = open_.join(above.hint("merge"), ["tree_id", "up"])
        rows = store(rows.select("tree_id", "msg_id", F.col("next").alias("up"), (F.col("score") + F.col("more")).alias("score"), (F.col("n") + F.col("m")).alias("n")), "reply-rows")
        ended.append(rows.filter("up IS NULL"))
    totals = ended[0]
    for e in ended[1:]:
        totals = totals.unionByName(e)
    return totals.select("tree_id", "msg_id", "score", "n"), leaves, jumps


def branches(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """All root-to-leaf paths, as tree_id, leaf_id, score and length (n), and the jumps that lead along them."""
    totals, leaves, jumps = climb(messages)
    paths = totals.join(leaves.hint("merge"), ["tree_id", "msg_id"], "left_semi")
    return paths.select("tree_id", F.col("msg_id").alias("leaf_id"), "score", "n"), jumps


def choose(paths: DataFrame, per_tree: int = 1) -> DataFrame:
    """The best branches of each tree: highest score, then longest path, then smallest leaf.

    For one branch a partial aggregate picks it, so a tree with very many branches meets in no single task; for more, a
    window ranks what is left of each tree.
    """
    order = F.struct((-F.col("score")).alias("s"), (-F.col("n")).alias("m"), "leaf_id")
    if per_tree == 1:
        best = paths.groupBy("tree_id").agg(F.min(order).alias("b"))
        return best.select("tree_id", F.col("b.leaf_id").alias("leaf_id"), (-F.col("b.m")).alias("n"), F.lit(1).alias("branch"))
    w = Window.partitionBy("tree_id").orderBy(order)
    return paths.withColumn("branch", F.row_number().over(w)).filter(F.col("branch") <= per_tree).drop("score")


def format_paths(chosen: DataFrame, jumps: list[DataFrame], messages: DataFrame) -> DataFrame:
    """tree_id, leaf_id, branch, formatted, segments: one conversation per chosen path.

    From the leaf, each jump of 2**k doubles the messages known to be on the path; level counts from the root. formatted
    is the text of all segments(text, loss) in order. Null roles and texts are empty.
    """
    steps = store(chosen.select("tree_id", "leaf_id", "branch", F.col("leaf_id").alias("msg_id"), F.col("n").alias("level")), "reply-steps")
    for k in reversed(range(len(jumps))):
        further = steps.join(jumps[k].hint("merge"), ["tree_id", "msg_id"]).select("tree_id", "leaf_id", "branch", F.col("up").alias("msg_id"), (F.col("level") - (1 << k)).alias("level"))
        steps = store(steps.unionByName(further), "reply-steps")
    texts = messages.select("tree_id", "msg_id", segments(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("part"))
    joined = steps.join(texts.hint("merge"), ["tree_id", "msg_id"])
    parts = joined.groupBy("tree_id", "leaf_id", "branch").agg(F.array_sort(F.collect_list(F.struct("level", "part"))).alias("parts"))
    whole = parts.select("tree_id", "leaf_id", "branch", F.flatten(F.transform("parts", lambda p: p["part"])).alias("segments"))
    return whole.select("tree_id", "leaf_id", "branch", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation, as array<struct<role, text>>."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(unescape(F.substring_index(F.substr(p, F.lit(len(START) + 1)), SEP, 1)).alias("role"), unescape(F.substr(p, F.locate(SEP, p) + len(SEP))).alias("text")))


def masked(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def linear(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) as reply trees: each row answers the row before it in its conversation.

    Rows go by turn, then role, then text; nulls come first. The score of a message is its number of characters. msg_id
    is the row's number in its conversation, so repeated turns and repeated rows are kept. Rows without a conv_id are one
    conversation: tree_id is a struct of conv_id, which is itself never null, so joins on it lose no row.
    """
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("msg_id", F.row_number().over(w))
    return rows.select(F.struct("conv_id").alias("tree_id"), "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text", F.coalesce(F.length("text"), F.lit(0)).cast("double").alias("score"))


def op5_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    tricky = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], T.StructType.fromDDL("conv_id long, turn long, role string, text string"))
    messages = store(linear(conv.unionByName(extra)), "reply-messages")
    paths, jumps = branches(messages)
    return digests(format_paths(choose(paths), jumps, messages))


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation of linear(), also for the one whose conv_id is null: turns are read from the formatted
    text, what the loss counts from the segments under the mask."""
    turns = formatted.select("tree_id.conv_id", "formatted", read_back(F.col("formatted")).alias("t"), masked(F.col("segments")).alias("said"))
    said = F.col("said")
    return turns.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"),
        F.sha2(said, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, '<|im_start|>' || replace(replace(role, '\', '\\'), '<|', '<\|') || '<|im_sep|>' || replace(replace(text, '\', '\\'), '<|', '<\|') || '<|im_end|>' || chr(10) AS part FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(part))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
