"""Attempts, questions and answers: grading roll-ups, statistics, planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quill.operators.ordered import numbered


def summary(attempts: DataFrame, user: str, percentage: str, start: str, stop: str) -> DataFrame:
    """Participants, attempts, average, best and worst percentage (nulls ignored), mean duration in seconds."""
    from quill.functions.values import whole_seconds

    return attempts.agg(F.countDistinct(user).alias("participants"), F.count(F.lit(1)).alias("attempts"), F.round(F.avg(percentage), 2).alias("average"), F.max(percentage).alias("best"), F.min(percentage).alias("worst"), F.round(F.avg(whole_seconds(F.col(start), F.col(stop)))).cast("long").alias("mean_seconds"))


def graded(answers: DataFrame, attempt: str, correct: Column, points: Column) -> DataFrame:
    """Score, highest score, correct answers and percentage (half up, 0 where nothing can be won) per attempt."""
    roll = answers.groupBy(attempt).agg(F.sum(F.when(correct, points).otherwise(0)).alias("score"), F.sum(points).alias("max_score"), F.count_if(correct).alias("n_correct"), F.count(F.lit(1)).alias("n_answers"))
    return roll.withColumn("percentage", F.when(F.col("max_score") == 0, F.lit(0.0)).otherwise(F.round(100 * F.col("score") / F.col("max_score"), 2)))


def question_accuracy(answers: DataFrame, question: Column, prompt: str, position: str, correct: Column) -> DataFrame:
    stats = answers.groupBy(question.alias("question")).agg(F.min(prompt).alias("prompt"), F.count(F.lit(1)).alias("answers"), F.count_if(correct).alias("n_correct"), F.min(position).alias("first_position"))
    return stats.withColumn("accuracy", F.when(F.col("answers") == 0, F.lit(0.0)).otherwise(F.round(100 * F.col("n_correct") / F.col("answers"), 2)))


def shares(weights: DataFrame, by: str, weight: str, total: Column, within: tuple[str, ...] = ()) -> DataFrame:
    """Largest remainders: whole shares of each part's total in proportion to weights; ties go to the smaller key."""
    exact = weights.withColumn("_exact", total * F.col(weight)).withColumn("share", F.floor("_exact"))
    rank = F.row_number().over(Window.partitionBy(*within).orderBy(F.desc(F.round(F.col("_exact") - F.col("share"), 9)), by))
    left = total - F.sum("share").over(Window.partitionBy(*within))
    return exact.withColumn("_rank", rank).withColumn("share", (F.col("share") + F.when(F.col("_rank") <= left, 1).otherwise(0)).cast("long")).drop("_exact", "_rank")


def interleaved(items: DataFrame, kind: str, order: str, size: int) -> DataFrame:
    """Items of alternating kinds in batches of ``size``: the k-th of each kind before any k+1-th."""
    placed = numbered(numbered(items, [order], "_k", [kind]), ["_k", kind], "place")
    return placed.withColumn("batch", F.floor((F.col("place") - 1) / size).cast("long")).drop("_k")
