"""Streams over completion events: running pace, event log, and windows over event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from folioflow.operators.common import ensure_checkpoint_dir, passing
from folioflow.operators.sequences import PACE_CAP, SEED_CHARS, SEED_SECONDS, fold_pace


def read_log(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "json", **options: str) -> DataFrame:
    """A growing folder of log files as a stream."""
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


def running_pace(events: DataFrame, cap: float = PACE_CAP, seed_chars: float = SEED_CHARS, seed_seconds: float = SEED_SECONDS) -> DataFrame:
    """(engine, voice, chars, seconds): a stream's sums per voice from a seed, both halved whenever the characters pass
    the cap; a row for each voice that a micro-batch brought samples of. Within a micro-batch they count by seq."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sums = tuple(state.get) if state.exists else (seed_chars, seed_seconds)
        rows = sorted(x for pdf in batches for x in zip(pdf["seq"].tolist(), pdf["chars"].tolist(), pdf["seconds"].tolist(), strict=True))
        sums = fold_pace(*sums, [(c, s) for _, c, s in rows], cap)
        state.update(sums)
        yield pd.DataFrame({"engine": [key[0]], "voice": [key[1]], "chars": [sums[0]], "seconds": [sums[1]]})

    kind = "engine string, voice string, chars double, seconds double"
    return events.groupBy("engine", "voice").applyInPandasWithState(update, kind, "chars double, seconds double", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, at: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(window, event_type, n): counts by tumbling windows of event time, late rows up to ``late`` counted. An extension."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there; its result is a table in the shared folder, not rows on the driver.

    In update mode each micro-batch's rows carry its number as batch, of which the greatest of a key counts.
    """
    spark = stream.sparkSession
    at = passing(spark, f"{ensure_checkpoint_dir(spark)}/{name}")

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("batch", F.lit(number).cast("bigint")) if mode == "update" else batch
        rows.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/out")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())]) if mode == "update" else stream.schema
    return spark.read.schema(schema).parquet(f"{at}/out")


def append_log(events: DataFrame, path: str) -> None:
    """Events appended to a folder of JSON lines."""
    events.select(F.to_json(F.struct(*events.columns)).alias("value")).write.mode("append").text(path)
