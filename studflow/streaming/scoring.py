"""Scoring as a stream: generated samples are scored as their files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalar import first_text
from ..operators.grammar import scores
from ..tables import checkpointed

SAMPLES = "id string, sample int, path string, text string"


def score_stream(spark: SparkSession, source: str, target: str, state: str, parts: DataFrame, colors: DataFrame, connectors: DataFrame, schema: str = SAMPLES) -> StreamingQuery:
    """Scores JSON lines that arrive in a folder, each batch of files once, and appends Parquet to target.

    Each row is scored on its own, so no state is kept between batches; state is the stream's checkpoint folder.
    """

    def one(batch: DataFrame, no: int) -> None:
        x = batch.withColumn("text", first_text(F.col("path"), F.col("text"))).withColumn("key", F.monotonically_increasing_id())
        x = checkpointed(x)  # the key must be the same for both readings, even if a block is lost between them
        s = scores(x, "key", "text", parts, colors, connectors)
        x.join(s, "key", "left").drop("key", "path").withColumn("batch", F.lit(no)).write.mode("append").parquet(target)

    return spark.readStream.schema(schema).json(source).writeStream.foreachBatch(one).option("checkpointLocation", state).trigger(availableNow=True).start()
