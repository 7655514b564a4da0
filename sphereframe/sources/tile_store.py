"""Scored tiles kept in batches that appear whole or not at all.

A batch is written to a folder of its own; a small commit record, renamed into place at the end, makes it visible.  A batch
that dies halfway leaves a folder that no record names; a batch of a name that is committed already adds nothing.  Readers
take the folders of the records only.  One writer at a time; any number of readers.
"""
from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import store
from .store import TILE_KEY

SCHEMA = "face int, ty int, tx int, values array<double>"


@dataclass(frozen=True)
class TileStore:
    """Tiles of ``size * size`` values under one identity (inputs, model, settings)."""
    spark: SparkSession
    path: str
    size: int

    def commits(self) -> dict[str, dict]:
        """Records by batch; those that a compaction replaced are left out."""
        fs, folder = store.file_system(self.spark, f"{self.path}/commits")
        if not fs.exists(folder):
            return {}
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        if not any(n.endswith(".json") for n in names):
            return {}
        lines = self.spark.read.text(f"{self.path}/commits/*.json").collect()  # one short line for each batch
        records = {r["batch"]: r for r in (json.loads(line.value) for line in lines)}
        replaced = {b for r in records.values() for b in r["replaces"]}
        return {b: r for b, r in sorted(records.items()) if b not in replaced}

    def committed(self, batch: str) -> dict | None:
        fs, record = store.file_system(self.spark, f"{self.path}/commits/{batch}.json")
        return json.loads(self.spark.read.text(str(record)).first().value) if fs.exists(record) else None

    def _sound(self) -> Column:
        return (F.col("values").isNotNull() & (F.size("values") == self.size * self.size)
                & F.forall("values", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))

    def append(self, tiles: DataFrame, batch: str, replaces: tuple[str, ...] = (), **noted) -> dict:
        """Write a batch and commit it with its row count and hashes; gives the record.

        Tiles of a wrong size or with values that are missing or not finite fail the batch, and nothing of it shows.
        """
        if "/" in batch or not batch:
            raise ValueError("a batch name is one path element")
        known = self.committed(batch)
        if known is not None:
            return known
        began, folder, seen = time.time(), f"batch={batch}-{uuid.uuid4().hex}", Observation("tiles")
        h = F.xxhash64(*TILE_KEY, "values")
        good = F.when(self._sound(), F.col("values")).otherwise(
            F.raise_error(F.lit(f"a tile is not {self.size} x {self.size} finite values")).cast("array<double>"))
        rows = tiles.select(*[F.col(k).cast("int").alias(k) for k in TILE_KEY], F.col("values").cast("array<double>").alias("values"))
        rows = rows.select(*TILE_KEY, good.alias("values")).repartitionByRange(*TILE_KEY).sortWithinPartitions(*TILE_KEY)
        (rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(20,0)")).cast("string").alias("hash_sum"),
                      F.bit_xor(h).alias("hash_xor")).write.parquet(f"{self.path}/data/{folder}"))
        record = {"batch": batch, "folder": folder, "replaces": list(replaces), **seen.get, "seconds": round(time.time() - began, 3), **noted}
        if not store.put_text(self.spark, f"{self.path}/commits/{batch}.json", json.dumps(record)):
            return self.committed(batch)
        return record

    def _folders(self, records: dict[str, dict]) -> DataFrame:
        if not records:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/data/{r['folder']}" for r in records.values()])

    def read(self) -> DataFrame:
        """Committed tiles; reading a value array of a wrong size or with bad values raises."""
        bad = F.raise_error(F.concat(F.lit("stored tile "), F.concat_ws(" ", *TILE_KEY), F.lit(" is invalid"))).cast("array<double>")
        return self._folders(self.commits()).select(*TILE_KEY, F.when(self._sound(), F.col("values")).otherwise(bad).alias("values"))

    def keys(self) -> DataFrame:
        return self._folders(self.commits()).select(*TILE_KEY)

    def differences(self) -> DataFrame:
        """``batch, rows, found_rows``: batches whose content is not what their record says, in one scan."""
        records = self.commits()
        told = self.spark.createDataFrame([(b, r["folder"], r["rows"], r["hash_sum"], r["hash_xor"]) for b, r in records.items()],
                                          "batch string, folder string, rows bigint, hash_sum string, hash_xor bigint")
        h = F.xxhash64(*TILE_KEY, "values")
        parts = F.split(F.input_file_name(), "/")
        found = self._folders(records).groupBy(F.get(parts, F.size(parts) - 2).alias("folder")).agg(
            F.count(F.lit(1)).alias("found_rows"), F.sum(h.cast("decimal(20,0)")).cast("string").alias("found_sum"), F.bit_xor(h).alias("found_xor"))
        both = told.join(found, "folder", "left")
        same = ((F.col("rows") == F.coalesce("found_rows", F.lit(0))) & F.col("hash_sum").eqNullSafe(F.col("found_sum"))
                & F.col("hash_xor").eqNullSafe(F.col("found_xor")))
        return both.where(~same).select("batch", "rows", F.coalesce("found_rows", F.lit(0)).alias("found_rows"))

    def compact(self) -> dict | None:
        """Many small batches become one; readers see the old ones or the new one, never both."""
        records = self.commits()
        if len(records) < 2:
            return None
        return self.append(self.read(), f"compact-{uuid.uuid4().hex}", tuple(records))


def open_tiles(spark: SparkSession, path: str, size: int, identity: dict | None = None) -> TileStore:
    """Open or create a store; one that was made with other inputs is refused, and so are batches without a manifest."""
    if store.exists(spark, f"{path}/commits") and not store.exists(spark, f"{path}/identity"):
        raise ValueError(f"{path} has tiles but no manifest")
    store.write_manifest(spark, f"{path}/identity", {"tile_size": size, **(identity or {})})
    return TileStore(spark, path, size)
