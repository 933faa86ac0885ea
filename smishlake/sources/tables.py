"""Sources and sinks: message intake with rejects, stores by date, key checks, feedback, tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Declared schemas of the logical tables.
SCHEMAS = {
    "messages": "msg_id long, raw_text string, sender_id string, source string, received_at timestamp, content_hash string",
    "analyses": "msg_id long, normalized_text string, language string, scam_family string, risk_score int, risk_level string, analysed_at timestamp",
    "indicators": "msg_id long, type string, value string, confidence double, ssrf_risk string, is_idn boolean",
    "conversation_messages": "conv_id long, turn long, role string, text string, ts timestamp",
    "feedback": "feedback_id string, analysis_id string, analyst_id string, is_correct boolean, comment string, recorded_at timestamp",
    "campaigns": "campaign_id string, scam_family string, member_count long, centroid array<double>, first_seen timestamp, last_seen timestamp, domains array<string>, senders array<string>, status string",
    "campaign_members": "campaign_id string, msg_id long, similarity double, confidence double, joined_at timestamp",
    "users": "user_id string, name string, role string, created_at timestamp",
    "audit": "event_id long, user_id string, action string, target string, happened_at timestamp",
}
#: Keys that stand once in a table, and (columns, table, columns) that must be found in another.
UNIQUE = {"messages": ("msg_id",), "analyses": ("msg_id",), "indicators": ("msg_id", "type", "value"), "conversation_messages": ("conv_id", "turn"), "feedback": ("analysis_id", "analyst_id"), "campaigns": ("campaign_id",), "campaign_members": ("campaign_id", "msg_id"), "users": ("user_id",), "audit": ("event_id",)}
FOREIGN = {"analyses": (("msg_id", "messages", "msg_id"),), "indicators": (("msg_id", "messages", "msg_id"),), "feedback": (("analysis_id", "analyses", "msg_id"), ("analyst_id", "users", "user_id")), "campaign_members": (("campaign_id", "campaigns", "campaign_id"), ("msg_id", "messages", "msg_id")), "audit": (("user_id", "users", "user_id"),)}
MAX_MESSAGE_CHARS = 5000
#: Bytes that a side of a join may be broadcast with.
MOST_BROADCAST = 8_000_000


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table of fewer files than there are cores, dealt over all cores: a file with one row group is read by one
    task, which then does all work that follows without a shuffle. Tables of more files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if len(df.inputFiles()) < cores else df


def read_any(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """Any batch source that Spark reads (parquet, json, csv, orc, jdbc)."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder in the warehouse where that is unset: both are shared by driver and executors."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared-tables"


def sized(df: DataFrame, row_bytes: int = 64, rows: int | None = None) -> DataFrame:
    """Hint how a join takes this side: broadcast up to MOST_BROADCAST bytes by count and bound of a row, a merge join beyond.
    With rows (a bound that is known) nothing is counted."""
    return df.hint("broadcast") if (df.count() if rows is None else rows) * row_bytes <= MOST_BROADCAST else df.hint("merge")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def persist_table(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there. A filter on the columns of `folders` reads only theirs."""
    path = new_folder(df.sparkSession, name)
    df.write.partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared file system, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def accept_messages(df: DataFrame, max_chars: int | None = MAX_MESSAGE_CHARS) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejects with a reason. Bad rows never fail the job."""
    reason = F.when(F.coalesce(F.length(F.trim("raw_text")), F.lit(0)) == 0, "empty")
    reason = reason.when(F.length("raw_text") > max_chars, "too_long") if max_chars else reason
    marked = df.withColumn("reject_reason", reason)
    return marked.filter("reject_reason IS NULL").drop("reject_reason"), marked.filter("reject_reason IS NOT NULL")


def accept_turns(df: DataFrame, most: int | None = None) -> DataFrame:
    """Conversation rows, optionally the first so many of each conversation."""
    if not most:
        return df
    w = Window.partitionBy("conv_id").orderBy("turn")
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def content_hash(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def save_by_date(df: DataFrame, path: str, time_col: str = "received_at", mode: str = "append") -> None:
    df.withColumn("day", F.to_date(time_col)).write.mode(mode).partitionBy("day").parquet(path)


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict[str, int]]:
    """Number of the last whole manifest of a table (0: none), and the version of each of its days."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(where)] if fs.exists(where) else []
    whole = [int(p.getName().split("=")[1]) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    if not whole:
        return 0, {}
    return max(whole), {r["day"]: r["version"] for r in spark.read.parquet(f"{path}/manifest/number={max(whole)}").collect()}  # a row a day


def _days(spark: SparkSession, path: str, schema: T.StructType, versions: dict[str, int]) -> DataFrame:
    """The given days of a table, each in its version; with day as a column."""
    whole = T.StructType([*schema.fields, T.StructField("version", T.IntegerType()), T.StructField("day", T.StringType())])
    if not versions:
        return spark.createDataFrame([], whole).drop("version")
    folders = [f"{path}/data/version={v}/day={d}" for d, v in versions.items()]
    return spark.read.schema(whole).option("basePath", f"{path}/data").parquet(*folders).drop("version")


def upsert_by_date(df: DataFrame, path: str, keys: list[str], time_col: str, revision_col: str) -> None:
    """Merges rows into a table that is kept by day.

    A row replaces the one with its keys unless that has a higher revision; of equal revisions the new row counts, and of
    such rows in df the one with the largest hash. A key keeps its day; rows without a time have a day of their own. Only
    days that df touches are written, as a new version of them; a manifest that names the version of each day is written
    last. So a job that dies half way changes nothing, and a batch that is run again gives the same rows.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    fresh = persist_table(df.withColumn("day", F.coalesce(F.date_format(time_col, "yyyy-MM-dd"), F.lit("none"))), "upsert-batch")
    number, versions = _manifest(spark, path)
    touched = [r["day"] for r in fresh.select("day").distinct().collect()]  # the days of one batch
    old = _days(spark, path, df.schema, {d: versions[d] for d in touched if d in versions})
    both = fresh.withColumn("_new", F.lit(1)).unionByName(old.withColumn("_new", F.lit(0))).withColumn("_h", F.xxhash64(*(c for c, kind in df.dtypes if "map<" not in kind)))
    first = F.row_number().over(Window.partitionBy("day", *keys).orderBy(F.desc_nulls_last(revision_col), F.desc("_new"), F.desc("_h")))
    merged = both.withColumn("_r", first).filter("_r = 1").drop("_r", "_new", "_h")
    merged.write.mode("overwrite").partitionBy("day").parquet(f"{path}/data/version={number + 1}")
    now = versions | dict.fromkeys(touched, number + 1)
    spark.createDataFrame(sorted(now.items()), "day string, version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/number={number + 1}")


def read_upserted(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of a table kept by upsert_by_date(), as its last whole manifest has them."""
    return _days(spark, path.rstrip("/"), schema, _manifest(spark, path.rstrip("/"))[1]).drop("day")


def write_clustered(df: DataFrame, path: str, order: list[Column]) -> None:
    """Writes a table in ranges of a sort order, so that a filter on its first column skips all files but a few."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)


def seek_page(df: DataFrame, order: list[tuple[str, bool]], limit: int, after: tuple | None = None) -> DataFrame:
    """The `limit` rows behind the row whose sort key is `after` (None: the first ones); order names columns and whether they
    go down. The columns together name a row and are not null. Nothing before the page is read where the store is clustered."""
    if after is not None:
        behind, equal = F.lit(False), F.lit(True)
        for (c, down), x in zip(order, after, strict=True):
            behind = behind | equal & (F.col(c) < x if down else F.col(c) > x)
            equal = equal & (F.col(c) == x)
        c, down = order[0]
        df = df.filter((F.col(c) <= after[0] if down else F.col(c) >= after[0]) & behind)  # the first part reaches the scan
    return df.orderBy(*(F.desc(c) if down else F.asc(c) for c, down in order)).limit(limit)


def fetch(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup; the filter reaches the scan."""
    return df.filter(F.col(key) == value)


def fetch_all(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key is listed; keys may be of any number."""
    return df.join(keys.distinct().hint("merge"), key, "left_semi")


def key_violations(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of a child table whose key is missing in the parent table."""
    return child.filter(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)).distinct().hint("merge"), child_key, "left_anti")


def check_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n: how often each declared key of the given tables is broken; foreign keys of tables that are not given are
    left out."""
    out = None
    for name, df in tables.items():
        found = [(f"{name}.{','.join(UNIQUE[name])}", key_violations(df.select(*UNIQUE[name]), *UNIQUE[name]))]
        for col, parent, key in FOREIGN.get(name, ()):
            if parent in tables:
                found.append((f"{name}.{col}->{parent}", orphans(df.select(F.col(col).cast("string")), tables[parent].select(F.col(key).cast("string")), col, key)))
        for label, rows in found:
            part = rows.agg(F.lit(label).alias("name"), F.count(F.lit(1)).alias("n"))
            out = part if out is None else out.unionByName(part)
    return out


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """One feedback per analysis and analyst: the last one."""
    w = Window.partitionBy("analysis_id", "analyst_id").orderBy(F.desc("recorded_at"), F.desc("feedback_id"))
    return feedback.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def feedback_for(analyses: DataFrame, feedback: DataFrame) -> DataFrame:
    """Analyses with number and share of right verdicts, none included."""
    agreed = latest_feedback(feedback).groupBy("analysis_id").agg(F.count(F.lit(1)).alias("n_feedback"), F.count_if("is_correct").alias("n_correct"))
    return analyses.join(agreed, "analysis_id", "left").fillna(0, ["n_feedback", "n_correct"])


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)
