"""Captions, render views and image-text scores."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import checkpointed

#: Members of a render archive: by prompt index, or by prompt key (fixed formats).
BY_INDEX = r"^prompt_(\d+)/prompt_\1_(\d+)\.(?:png|jpg|jpeg)\z"
BY_KEY = r"^([^/]+)/\1_(\d+)\.(?:png|jpg|jpeg)\z"


def ranks(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the rank (from 0) of each row in a global order, without sorting all rows in one task: rows are
    range-partitioned, counted, and numbered within their partition."""
    x = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    x = x.withColumn("__id", F.monotonically_increasing_id())
    x = checkpointed(x)  # partitions must not be drawn anew between counting and numbering
    w = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    n = x.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    n = n.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    return x.join(F.broadcast(n.select("__p", "__first", "__before")), "__p").withColumn(name, F.col("__before") + F.col("__id") - F.col("__first")).drop("__p", "__id", "__first", "__before")


def prompts(captions: DataFrame, line: str = "line_no") -> DataFrame:
    """prompt_index, prompt_key, caption: the captions in order, trimmed, with a key made up where there's none. Rows
    without a caption aren't prompts."""
    x = ranks(captions.where(F.col("caption").isNotNull()).select(line, "id", "caption"), [F.col(line)], "prompt_index")
    key = F.coalesce("id", F.concat(F.lit("prompt_"), F.when(F.length(F.col("prompt_index").cast("string")) < 4, F.lpad(F.col("prompt_index").cast("string"), 4, "0")).otherwise(F.col("prompt_index").cast("string"))))
    return x.select("prompt_index", key.alias("prompt_key"), F.regexp_replace("caption", r"(?U)^\s+|\s+\z", "").alias("caption"))


def views(members: DataFrame, prompts_: DataFrame) -> DataFrame:
    """prompt_index, archive, views: the render views of each prompt in order. members: archive, name. Of several
    archives with views of a prompt the last by name has them all; of several prompts with a key the last."""
    keys = prompts_.groupBy("prompt_key").agg(F.max("prompt_index").alias("by_key"))
    x = members.withColumn("index", F.regexp_extract("name", BY_INDEX, 1)).withColumn("key", F.regexp_extract("name", BY_KEY, 1))
    view = F.when(F.col("index") != "", F.regexp_extract("name", BY_INDEX, 2)).otherwise(F.regexp_extract("name", BY_KEY, 2)).try_cast("bigint")
    x = x.withColumn("view", view).join(keys, (F.col("index") == "") & (F.col("key") == F.col("prompt_key")), "left")
    x = x.withColumn("prompt_index", F.coalesce(F.nullif("index", F.lit("")).try_cast("bigint"), "by_key")).where("prompt_index is not null")
    per = x.groupBy("prompt_index", "archive").agg(F.array_sort(F.collect_list(F.struct("view", "name"))).alias("v"))
    last = per.groupBy("prompt_index").agg(F.max_by("v", "archive").alias("v"), F.max("archive").alias("archive"))
    return last.select("prompt_index", "archive", F.transform("v", lambda s: s["name"]).alias("views"))


def missing(prompts_: DataFrame, views_: DataFrame) -> DataFrame:
    """The prompts without views."""
    return prompts_.join(views_, "prompt_index", "left_anti")


def pooled(scores: DataFrame, by: list[str], score: str) -> DataFrame:
    """by, max_score, mean_score over the views of each prompt."""
    return scores.groupBy(*by).agg(F.max(score).alias("max_score"), F.avg(score).alias("mean_score"))


def metric(pooled_: DataFrame) -> DataFrame:
    """One row: the number of prompts and the mean of their best scores."""
    return pooled_.agg(F.count("*").alias("n_prompts"), F.avg("max_score").alias("score"))


def worklist(prompts_: DataFrame, k: int) -> DataFrame:
    """Each prompt k times, with a sample number."""
    return prompts_.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def required(prompts_: DataFrame, views_: DataFrame) -> DataFrame:
    """prompts with their archive and views. Prompts without views fail the job, with their number and the first few."""
    lost = missing(prompts_, views_).groupBy().agg(F.count("*").alias("n"), F.min(F.struct("prompt_index", "prompt_key")).alias("first"))

    def fail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if n:
                    raise FileNotFoundError(f"{n} prompts have no rendered views (first: {first})")
        yield from ()

    found = prompts_.join(views_, "prompt_index").select("prompt_index", "prompt_key", "caption", "archive", "views")
    schema = found.schema
    return found.unionByName(lost.select("n", "first.prompt_key").mapInArrow(fail, schema))


def rows_of(scores: DataFrame, question: Column | None = None) -> DataFrame:
    """prompt_index, prompt_key, caption, (question,) scores, max_score, mean_score: what an evaluation writes for each
    prompt. scores: prompt_index, prompt_key, caption, view, score."""
    by = ["prompt_index", "prompt_key", "caption"]
    x = scores.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("view", "score"))), lambda s: s["score"]).alias("scores"), F.max("score").alias("max_score"), F.avg("score").alias("mean_score"))
    return x.select(*by, *([question.alias("question")] if question is not None else []), "scores", "max_score", "mean_score")


def checked_prompts(prompts_: DataFrame) -> DataFrame:
    """prompts, of which there must be any."""

    def fail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.column(0)[0].as_py() == 0:
                raise ValueError("no prompts found")
        yield from ()

    return prompts_.unionByName(prompts_.groupBy().agg(F.count("*").alias("n")).mapInArrow(fail, prompts_.schema))
