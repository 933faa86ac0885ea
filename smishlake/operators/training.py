"""Leakage-free splits, confidence calibration, a classifier and its metrics."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smishlake.sources.tables import persist_table

LOW_CONFIDENCE = 0.65
SHARES = (0.7, 0.1, 0.2)


def template_hash(c: Column) -> Column:
    """Same for texts that differ in white space or case only."""
    return F.sha2(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")), 256)


def template_groups(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.groupBy(template_hash(F.col(text_col)).alias("template")).agg(F.count(F.lit(1)).alias("n"))


def leakage_free_split(df: DataFrame, text_col: str = "text", shares=SHARES, seed: int = 42) -> DataFrame:
    """Adds template and split (train, val, test); all rows of a template share a split.

    A template's place follows from a hash of it, so no shuffle, sort or join is needed and new rows never move old ones;
    shares of templates are met up to chance.
    """
    df = df.withColumn("template", template_hash(F.col(text_col)))
    place = F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), "template"), 256), 1, 8), 16, 10).cast("long"), F.lit(1_000_000)) / 1_000_000
    return df.withColumn("split", F.when(place < shares[0], "train").when(place < shares[0] + shares[1], "val").otherwise("test"))


def _kth(groups: DataFrame, k: int) -> str | None:
    """The k-th smallest key, counted from 0, without a sort of all: a histogram of the keys' first digits finds the
    stretch that holds it, and only that stretch is ordered."""
    digits = 4
    counts = {r["b"]: r["n"] for r in groups.groupBy(F.substring("key", 1, digits).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 16 ** 4 rows at most
    for b in sorted(counts):
        if k < counts[b]:
            return groups.filter(F.col("key").startswith(b)).orderBy("key").offset(k).limit(1).first()["key"]
        k -= counts[b]
    return None


def exact_split(df: DataFrame, text_col: str = "text", shares=SHARES, seed: int = 42) -> DataFrame:
    """As leakage_free_split with exact shares of templates, cut at two ranks of the shuffled templates."""
    df = df.withColumn("template", template_hash(F.col(text_col)))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), "template"), 256)
    groups = persist_table(df.select(key.alias("key")).distinct(), "split-templates")
    n = groups.count()
    first, second = (_kth(groups, round(n * x)) for x in (shares[0], shares[0] + shares[1]))
    below = lambda cut: F.lit(True) if cut is None else key < cut
    return df.withColumn("split", F.when(below(first), "train").when(below(second), "val").otherwise("test"))


def split_overlap(split: DataFrame) -> DataFrame:
    """Templates in more than one split; empty when nothing leaks."""
    return split.groupBy("template").agg(F.count_distinct("split").alias("n")).filter("n > 1")


def calibrate(df: DataFrame) -> DataFrame:
    """(probability, text_confidence, label, normalized_text) -> final confidence, risk, family and level.

    An empty text is SAFE with confidence 1 and risk 0; low confidence is SAFE with the risk scaled down.
    """
    final = F.col("probability") * F.col("text_confidence")
    empty = F.trim("normalized_text") == ""
    low, safe = final < LOW_CONFIDENCE, F.col("label") == "SAFE"
    return df.select(
        "*",
        F.when(empty, 1.0).otherwise(final).alias("final_confidence"),
        F.when(empty, 0.0).when(low, final * 0.3).when(safe, 1 - final).otherwise(final).alias("risk"),
        F.when(empty | low | safe, "SAFE").otherwise(F.col("label")).alias("family"),
        F.when(empty | low | safe, "SAFE").otherwise("MALICIOUS").alias("level"),
        (~empty & low).alias("is_low_confidence"),
    )


def arg_max(probabilities: Column, names: Column) -> Column:
    return F.element_at(names, F.array_position(probabilities, F.array_max(probabilities)).cast("int"))


def train_classifier(train: DataFrame, text_col: str = "text", label_col: str = "label", features: int = 1 << 16) -> PipelineModel:
    """Words, hashed and weighted, into a multinomial logistic regression."""
    stages = [
        StringIndexer(inputCol=label_col, outputCol="_label", handleInvalid="skip"),
        RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=r"\P{L}+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="features"),
        LogisticRegression(labelCol="_label", maxIter=20, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(train)


def predict(model: PipelineModel, df: DataFrame, label_col: str = "label") -> DataFrame:
    """Adds predicted (a label)."""
    names = F.array(*map(F.lit, model.stages[0].labels))
    out = model.transform(df.withColumn(label_col, F.coalesce(F.col(label_col), F.lit(model.stages[0].labels[0]))))
    return out.withColumn("predicted", F.element_at(names, (F.col("prediction") + 1).cast("int")))


def confusion(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """class, precision, recall, f1, support of every class that is a label or a prediction; empty divisions are 0."""
    pairs = confusion(df, label, predicted)
    true = pairs.groupBy(F.col(label).alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0)).alias("hits"))
    said = pairs.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("said"))
    both = true.join(said, "class", "full_outer").fillna(0, ["support", "hits", "said"])
    p = F.when(F.col("said") > 0, F.col("hits") / F.col("said")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    return both.select("class", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), "support", "hits")


def overall_metrics(classes: DataFrame) -> DataFrame:
    return classes.agg((F.sum("hits") / F.sum("support")).alias("accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))
