"""Region requests as a stream: stream-static lookups, error isolation and incremental tiles."""
from __future__ import annotations

import hashlib
import threading
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators import region, tiles
from ..sources import store
from ..sources.blocks import BlockStore
from ..sources.tile_store import TileStore

REQUEST_SCHEMA = ("request_id bigint, ts timestamp, west double, south double, east double, "
                  "north double, width int, height int")


def read_requests(spark: SparkSession, path: str, fmt: str = "json", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(REQUEST_SCHEMA).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def answer(requests: DataFrame, field: DataFrame, h: int, native_height: int | None = None) -> DataFrame:
    """Append-only stream of region pixels: a stream-static join with the field's cells."""
    return region.region_query_lonlat(requests, field, h, native_height=native_height, spread=False)


class BatchCounts(StreamingQueryListener):
    """What a stream observed in each micro-batch, without another pass: ``rows[batch]`` holds its metrics and seconds.

    A repeated batch replaces its row.  ``finished`` is set when the stream has ended and all its batches are in.
    """

    def __init__(self, name: str):
        self.name, self.rows, self.finished, self.failure = name, {}, threading.Event(), None

    def onQueryStarted(self, event):
        self.finished.clear()

    def onQueryProgress(self, event):
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None:
            self.rows[event.progress.batchId] = {**seen.asDict(), "seconds": event.progress.durationMs.get("triggerExecution", 0) / 1000}

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.failure = event.exception
        self.finished.set()


def observe_requests(requests: DataFrame, name: str, native_height: int | None = None) -> DataFrame:
    """Judged requests that tell a listener how many there were, and how many bad, in each micro-batch."""
    checked = region.validate(requests, native_height)
    return checked.observe(name, F.count(F.lit(1)).alias("requests"), F.count("error").alias("errors"),
                           F.sum(F.when(F.col("error").isNull(), F.col("width").cast("bigint") * F.col("height"))).alias("pixels"))


def serve(requests: DataFrame, field: DataFrame | BlockStore, h: int, good_path: str, bad_path: str,
          checkpoint: str, native_height: int | None = None, trigger: dict | None = None, repeats_within: str | None = None):
    """Run the request loop: good requests give pixels, bad ones give an error row, none stops it.

    ``repeats_within`` keeps the ids of that time as state, over restarts too, and answers a repeated request once.
    Each micro-batch writes to its own folder, so a repeated batch replaces itself.  Of a field in blocks it reads those
    under its requests only; a node table gives its cells again for each micro-batch.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        checked = store.stage(region.validate(batch, native_height), "checked")  # the batch is read and judged once
        (checked.where(F.col("error").isNotNull()).select("request_id", "ts", "error")
         .write.mode("overwrite").parquet(f"{bad_path}/batch={batch_id}"))
        good = checked.where(F.col("error").isNull()).drop("error")
        answers = region.region_query_stored(good, field) if isinstance(field, BlockStore) else region.region_query_lonlat(good, field, h)
        (answers.write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}"))
    requests = unique_requests(requests, repeats_within) if repeats_within else requests
    return (requests.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def progress(requests: DataFrame, window: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Requests and errors per event-time window; rows later than the watermark are left out.

    In update mode every batch gives the windows that it changed, so no window waits for its end.
    """
    checked = region.validate(requests).withWatermark("ts", lateness)
    return checked.groupBy(F.window("ts", window)).agg(
        F.count(F.lit(1)).alias("requests"), F.count("error").alias("errors")).select(
        F.col("window.start").alias("start"), "requests", "errors")


def keep_progress(requests: DataFrame, path: str, checkpoint: str, window: str = "1 hour", lateness: str = "1 hour",
                  trigger: dict | None = None):
    """Write the state of every changed window, a folder for each batch; :func:`latest_progress` reads it."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return (progress(requests, window, lateness).writeStream.outputMode("update").foreachBatch(handle)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def latest_progress(spark: SparkSession, path: str) -> DataFrame:
    """The last written state of each window, windows that are still open included."""
    rows = spark.read.schema("start timestamp, requests bigint, errors bigint, batch bigint").parquet(path)
    last = rows.groupBy("start").agg(F.max_by(F.struct("requests", "errors"), "batch").alias("s"))
    return last.select("start", "s.requests", "s.errors")


def unique_requests(requests: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Drop repeats of a request id that arrive within the lateness bound."""
    return requests.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["request_id"])


def score_incremental(needed: DataFrame, contexts_of, load, saved: TileStore, batch: str, inputs=("values",),
                      rows: int = 64) -> tuple[DataFrame, dict]:
    """Score the tiles that the store lacks, commit them as one batch, and give all needed ones with the counts of the run.

    The store is checked before any context is gathered; used and reused tiles are counted while the missing ones are
    staged, scored ones while they are written.  ``contexts_of`` maps tile keys to model inputs.  A batch that is committed
    scores nothing again.
    """
    began, seen = time.time(), Observation("needed")
    known = saved.keys().distinct().withColumn("__saved", F.lit(True))
    marked = needed.select(*tiles.TILE_KEY).distinct().join(known, tiles.TILE_KEY, "left")
    marked = marked.observe(seen, F.count(F.lit(1)).alias("used"), F.count("__saved").alias("reused"))
    todo = store.stage(marked.where("__saved is null").drop("__saved"), "todo")
    counts = {**seen.get, "scored": 0}
    if counts["used"] > counts["reused"]:
        if saved.committed(batch):
            raise ValueError(f"batch {batch} is committed, with other tiles")
        scored = tiles.score_tiles(contexts_of(todo), load, saved.size, inputs, batch=rows)
        counts["scored"] = saved.append(scored, batch, used=counts["used"], reused=counts["reused"])["rows"]
    counts["seconds"] = round(time.time() - began, 3)
    return tiles.saved_tiles(needed, saved.read()), counts


def feed_tile_store(requests: DataFrame, needed_of, contexts_of, load, saved: TileStore, checkpoint: str,
                    trigger: dict | None = None):
    """Keep a tile store complete for a stream of requests.

    A batch of the store is named after the stream's checkpoint and the micro-batch, so a repeated one is known by name.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def handle(batch: DataFrame, batch_id: int) -> None:
        good = region.good_requests(batch)
        score_incremental(needed_of(good), contexts_of, load, saved, f"{stream}-{batch_id}")
    return (requests.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
