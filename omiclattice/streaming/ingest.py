"""Structured Streaming forms of incremental arrival, listing and decay."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from omiclattice.functions.materialise import settle, shared_dir
from omiclattice.sources.sinks import write_snapshot


def file_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """Stream of one Parquet table inside a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over everything available now and return its output.

    State and progress live in the shared folder, so a lost executor or a
    restart resumes. In update mode each batch's changed rows are kept with
    their batch number.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/omiclattice/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        q = writer.outputMode("append").format("parquet").option("path", out).start()
        schema = stream.schema
    else:
        def keep(batch: DataFrame, batch_id: int) -> None:
            # keyed by batch number: a replayed batch rewrites its own rows
            batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{out}/b={batch_id}")

        q = writer.outputMode(mode).foreachBatch(keep).start()
        schema = StructType([*stream.schema.fields, StructField("batch_id", LongType())])
    q.awaitTermination()
    reader = spark.read.schema(schema)
    return reader.parquet(out) if mode == "append" else reader.parquet(f"{out}/b=*")


def deduplicated(cells: DataFrame, ts: str, delay: str, keys: list[str]) -> DataFrame:
    """First arrival of each cell within the watermark; late repeats dropped."""
    return cells.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def stored_versions(spark: SparkSession, path: str) -> DataFrame | None:
    """(session_id, block, stored): the upload that each block of a snapshot comes from; None before the first."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND" or e.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            return None
        raise
    return found.groupBy(F.col("session_id").cast("string").alias("session_id"), F.col("block").cast("string").alias("block")).agg(F.max("pos").alias("stored"))


def merge_uploads(batch: DataFrame, path: str) -> None:
    """Blocks of a batch replace older ones of the snapshot; an older upload that comes late changes nothing.

    A block's rows keep the number ``pos`` of their upload, so versions and data
    are written together: a batch that is run again writes the same blocks again.
    """
    newest = batch.groupBy("session_id", "block").agg(F.max("pos").alias("pos"))
    stored = stored_versions(batch.sparkSession, path)
    if stored is not None:
        newest = newest.join(stored, ["session_id", "block"], "left").where("stored IS NULL OR pos >= stored").drop("stored")
    won = settle(newest)  # read before its folder is written to
    write_snapshot(batch.join(won, ["session_id", "block", "pos"]), path)


def start_upload_stream(uploads: DataFrame, path: str, checkpoint: str):
    """Merge uploads into a session snapshot, whatever order and batches they come in: :func:`merge_uploads`.

    ``uploads``: session_id, block, feature_id, sample_id, value, pos; the
    upload with the highest ``pos`` is a block's newest.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_uploads(batch, path)

    return uploads.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge).trigger(availableNow=True).start()


def since(items: DataFrame, ts: str, start: str) -> DataFrame:
    return items.where(F.col(ts) >= F.lit(start).cast("timestamp"))


def windowed_counts(items: DataFrame, ts: str, key: str, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Tumbling counts per key; a window closes once the watermark passes it."""
    w = items.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("window_start"), key, "n")


def decayed_relevance(items: DataFrame, ts: str, key: str, value: str, delay: str = "10 minutes",
                      width: str = "1 day", half_life_hours: float = 168.0) -> DataFrame:
    """Sum of values per key and window, each decayed to the window's end."""
    age = (F.unix_micros("wend") - F.unix_micros("ts")) / 3.6e9
    d = items.withWatermark(ts, delay).select(F.col(ts).alias("ts"), key, value, F.window(ts, width).alias("w"))
    d = d.withColumn("wend", F.col("w.end")).withColumn("x", F.col(value) * F.exp(-age * F.ln(F.lit(2.0)) / half_life_hours))
    g = d.groupBy("w", key).agg(F.sum("x").alias("relevance"))
    return g.select(F.col("w.end").alias("window_end"), key, "relevance")


def access_counters(events: DataFrame, key: str, ts: str) -> DataFrame:
    """Running access count and last access per item (update mode)."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("access_count"), F.max(ts).alias("last_accessed"))


def latest(updates: DataFrame, key: str) -> DataFrame:
    """Last state of every key from update-mode output."""
    cols = [c for c in updates.columns if c not in (key, "batch_id")]
    return updates.groupBy(key).agg(F.max_by(F.struct(*cols), "batch_id").alias("s")).select(key, "s.*")
