"""How good retrieval is: metrics of ranked hits, of a run over gold questions, and of two runs against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranking(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: hit1, hit3, recall3, mrr, context_recall over questions. ``hits`` is (question, rank, doc_id), ``gold`` (question, doc_id), distinct; a question without hits counts 0."""
    found = gold.join(hits, ["question", "doc_id"], "left")
    q = found.groupBy("question").agg(F.min("rank").alias("first"), F.sum((F.col("rank") <= 3).cast("int")).alias("in3"), F.count("rank").alias("any"), F.count("*").alias("n"))
    yes = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return q.agg(
        yes(F.col("first") == 1).alias("hit1"), yes(F.col("first") <= 3).alias("hit3"), F.avg(F.coalesce("in3", F.lit(0)) / F.col("n")).alias("recall3"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg(F.col("any") / F.col("n")).alias("context_recall")
    )


def answered(hits: DataFrame, locators: DataFrame, questions: DataFrame) -> DataFrame:
    """What a run came to: questions (question, category, abstains, ms) with recall of their locators (question, document, needle) in hits (question, doc_id, text, score), full, abstained, correct.

    A locator is found if a hit of its document holds its needle. A question is abstained from if no hit scores over 0;
    it is answered right if that is as it should be and, where there is an answer, all its locators were found.
    """
    l_ = locators.dropDuplicates(["question", "document", "needle"])
    at = l_.join(hits.select("question", F.col("doc_id").alias("document"), "text"), ["question", "document"], "left")
    each = at.groupBy("question", "document", "needle").agg(F.max(F.coalesce(F.contains("text", "needle"), F.lit(False)).cast("int")).alias("hit"))
    n = each.groupBy("question").agg(F.sum("hit").alias("found"), F.count("*").alias("wanted"))
    top = hits.groupBy("question").agg(F.max("score").alias("top"))
    r = questions.join(n, "question", "left").join(top, "question", "left")
    recall = F.coalesce(F.col("found") / F.col("wanted"), F.lit(0.0))
    full = F.coalesce(F.col("found") == F.col("wanted"), F.lit(False))
    out = r.withColumns({"recall": recall, "full": full, "abstained": F.coalesce("top", F.lit(0.0)) <= 0})
    return out.withColumn("correct", (F.col("abstained") == F.col("abstains")) & (F.col("abstains") | F.col("full"))).drop("found", "wanted", "top")


def summary(results: DataFrame) -> DataFrame:
    """By category, and of all under null: questions, recall, full, abstain_accuracy, accuracy, mean_ms, p95_ms (the value at 95 % of the sorted times, rounded down, not interpolated)."""
    rate = lambda c: F.avg(c.cast("double"))
    times = F.array_sort(F.collect_list("ms"))
    at = F.greatest(F.lit(1), F.floor(F.count("ms") * 0.95)).cast("int")
    return results.rollup("category").agg(
        F.count("*").alias("questions"), F.avg("recall").alias("recall"), rate(F.col("full")).alias("full"), rate(F.col("abstained") == F.col("abstains")).alias("abstain_accuracy"), rate(F.col("correct")).alias("accuracy"), F.avg("ms").alias("mean_ms"), F.element_at(times, at).alias("p95_ms")
    )


def compared(base: DataFrame, arm: DataFrame) -> DataFrame:
    """(metric, base, arm, delta, relative) of two tables (metric, value); a change from 0 is relative 0."""
    j = base.select("metric", F.col("value").alias("base")).join(arm.select("metric", F.col("value").alias("arm")), "metric")
    d = F.col("arm") - F.col("base")
    return j.withColumns({"delta": d, "relative": F.when(F.col("base") == 0, 0.0).otherwise(d / F.col("base"))})


def quality_summary(documents: DataFrame) -> DataFrame:
    """(status, documents): how many documents have each status."""
    return documents.groupBy(F.coalesce("quality", F.lit("UNKNOWN")).alias("status")).agg(F.count("*").alias("documents"))


def directory_status(tree: DataFrame) -> DataFrame:
    """(directory, status): of (directory, place, status) of what is under it, the first failure in reading order if there is any, else processing while anything is, else ready."""
    w = Window.partitionBy("directory").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    failed = F.first(F.when(F.col("status").startswith("failed"), F.col("status")), True).over(w)
    busy = F.max(F.col("status").isin("pending", "processing").cast("int")).over(w)
    return tree.select("directory", F.coalesce(failed, F.when(busy == 1, "processing").otherwise("ready")).alias("status")).distinct()
