"""Fields stored as square blocks in curve order, under a tree of digests.

A row is one block: its place and one row-major array a channel, so a region needs a few rows and never a node table.  Blocks
follow a Z-order curve over faces; files are sorted by it, row groups carry its range, and at most 4,096 folders its leading
bits, so a read opens what its curve ranges touch, whatever the size of the field.

Each block has a digest; each digest level has one row for 4,096 neighbours of the level below, up to a root in the manifest.
Opening reads the root's level only (of up to 4,096 blocks, all digests).  A query checks the blocks that it reads against
their digests, and those digests against the root, within the groups it touches.
"""
from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lookup import broadcast_if_bounded
from . import store

VERSION = 2
KINDS = {"float": T.FloatType(), "double": T.DoubleType()}
PLACE = ["face", "by", "bx"]
FRAME = ["y0", "x0", "h", "w"]
LEADING_BITS = 12  # at most 4,096 folders, and as many ranges known to the driver
FAN_BITS = 12      # digests under one of the next level
RANGES = 32        # curve ranges in a pushed filter; the folders are listed exactly


@dataclass(frozen=True)
class Lattice:
    """Nodes 0..last_row by 0..last_col of each face in blocks of ``block`` cells with their closing nodes.

    ``cube``: ``size`` intervals a face.  ``lonlat``: ``size`` latitude intervals; column ``2 size`` is column 0 again.
    """
    kind: str
    size: int
    block: int

    def __post_init__(self):
        if self.kind not in ("cube", "lonlat") or self.size < 1 or self.block < 1:
            raise ValueError("a lattice is cube or lonlat, with positive sizes")

    @property
    def faces(self) -> int:
        return 6 if self.kind == "cube" else 1

    @property
    def last(self) -> tuple[int, int]:
        return self.size, self.size if self.kind == "cube" else 2 * self.size

    @property
    def count(self) -> tuple[int, int]:
        return tuple(-(-n // self.block) for n in self.last)

    @property
    def blocks(self) -> int:
        return self.faces * self.count[0] * self.count[1]

    @property
    def bits(self) -> int:
        return max(1, (max(self.count) - 1).bit_length())

    @property
    def range_shift(self) -> int:
        """Curve keys without these bits have 4,096 values at most."""
        return max(0, 2 * self.bits + (3 if self.faces > 1 else 0) - LEADING_BITS)

    @property
    def folder_shift(self) -> int:
        """The same for folders, which hold 4,096 blocks or more (one folder, if there are no more)."""
        return max(FAN_BITS, self.range_shift)

    def curve(self, face: Column, by: Column, bx: Column) -> Column:
        """Z-order key: the bits of row and column alternate below the face."""
        spread = face.cast("bigint") * (1 << (2 * self.bits))
        for k in range(self.bits):
            for value, low in ((by, 1), (bx, 0)):
                spread = spread + F.shiftleft(F.shiftright(value.cast("bigint"), k).bitwiseAND(F.lit(1)), 2 * k + low)
        return spread

    def owner(self, y: Column, x: Column) -> tuple[Column, Column]:
        """The block that owns a node or cell inside the face; closing edges belong to the last block."""
        return tuple(F.least(F.floor(c / F.lit(self.block)).cast("int"), F.lit(k - 1)) for c, k in zip((y, x), self.count, strict=True))


def pack(field: DataFrame, lattice: Lattice, kind: str = "float") -> DataFrame:
    """Blocks of a node table ``[face,] y, x, values...``; raises on nodes that are missing, repeated or not finite.

    A node on the edge between blocks is in both, so that each block holds all corners of its cells.
    """
    values = [c for c in field.columns if c not in store.CUBE_KEY]
    face = F.col("face") if lattice.kind == "cube" else F.lit(0)
    columns = F.array("x") if lattice.kind == "cube" else F.when(F.col("x") == 0, F.array(F.lit(0), F.lit(lattice.last[1]))).otherwise(F.array("x"))
    rows = field.select(face.cast("int").alias("face"), F.col("y").cast("int").alias("y"),
                        F.explode(columns.cast("array<int>")).alias("x"), *[F.col(v).cast(kind).alias(v) for v in values])
    b = F.lit(lattice.block)

    def homes(c: str, count: int) -> Column:
        own = F.floor(F.col(c) / b).cast("int")
        before = F.when((F.pmod(F.col(c), b) == 0) & (F.col(c) > 0), own - 1)
        return F.array_compact(F.array(before, F.when(own < count, own)))
    rows = rows.withColumn("by", F.explode(homes("y", lattice.count[0]))).withColumn("bx", F.explode(homes("x", lattice.count[1])))
    y0, x0 = F.col("by") * b, F.col("bx") * b
    h, w = (F.least(o + b, F.lit(n)) - o + 1 for o, n in zip((y0, x0), lattice.last, strict=True))
    rows = rows.select(*PLACE, ((F.col("y") - y0) * w + F.col("x") - x0).alias("pos"), *values)
    grouped = rows.groupBy(*PLACE).agg(F.array_sort(F.collect_list(F.struct("pos", *values))).alias("nodes"))
    grouped = grouped.select(*PLACE, y0.alias("y0"), x0.alias("x0"), h.alias("h"), w.alias("w"), "nodes")
    whole = (F.size("nodes") == F.col("h") * F.col("w")) & (F.size(F.array_distinct("nodes.pos")) == F.size("nodes"))
    sound = F.lit(True)
    for v in values:
        sound = sound & F.forall(f"nodes.{v}", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))

    def checked(v):
        array = f"array<{kind}>"
        return (F.when(~whole, F.raise_error(F.lit("a block has missing or repeated nodes")).cast(array))
                .when(~sound, F.raise_error(F.lit("a block has values that are missing or not finite")).cast(array)).otherwise(F.col(f"nodes.{v}")))
    return grouped.select(lattice.curve(F.col("face"), F.col("by"), F.col("bx")).alias("z"), *PLACE, *FRAME,
                          *[checked(v).alias(v) for v in values])


def block_digest(values: Sequence[str]) -> Column:
    return F.xxhash64(*PLACE, *FRAME, *values)


def _next_level(level: DataFrame) -> DataFrame:
    return level.groupBy(F.shiftright("z", FAN_BITS).alias("z")).agg(
        F.xxhash64(F.array_sort(F.collect_list(F.struct("z", "digest")))).alias("digest"))


LEVEL = T.StructType([T.StructField("z", T.LongType()), T.StructField("digest", T.LongType())])


@dataclass(frozen=True)
class BlockStore:
    """A saved field; ``values`` are typed columns whose metadata holds their unit and whatever the writer said."""
    spark: SparkSession
    path: str
    lattice: Lattice
    values: T.StructType
    info: dict

    def _level(self, k: int) -> DataFrame:
        return self.spark.read.schema(LEVEL).parquet(f"{self.path}/digests/level={k}")

    def _table(self) -> DataFrame:
        whole = [T.StructField("z", T.LongType()), *[T.StructField(c, T.IntegerType()) for c in (*PLACE, *FRAME)],
                 *self.values.fields, T.StructField("part", T.IntegerType())]
        return self.spark.read.schema(T.StructType(whole)).parquet(f"{self.path}/field")

    def ranges(self, touched: DataFrame) -> tuple[list[int], list[tuple[int, int]]]:
        """Folders, and at most RANGES curve ranges that hold all of ``z``; the driver gets 4,096 rows at most."""
        parts = touched.groupBy(F.shiftright("z", self.lattice.range_shift)).agg(
            F.min("z").alias("low"), F.max("z").alias("high")).collect()
        spans = sorted((r.low, r.high) for r in parts)
        widest = sorted(range(1, len(spans)), key=lambda i: spans[i - 1][1] - spans[i][0])[:RANGES - 1]
        cuts = [0, *sorted(widest), len(spans)]
        return sorted({low >> self.lattice.folder_shift for low, _ in spans}), [(spans[a][0], spans[b - 1][1]) for a, b in zip(cuts, cuts[1:]) if a < b]

    def read(self, touched: DataFrame | None = None, check: bool = True) -> DataFrame:
        """Blocks at the curve keys of ``touched`` (all without it), with every array checked against its digest.

        The digests themselves are checked up to the root first.  ``check=False`` gives ``stored`` and ``found`` digests instead.
        """
        names = self.values.names
        blocks, digests = self._table(), self._level(0).withColumnRenamed("digest", "stored")
        if touched is not None:
            touched = store.stage(touched.select("z").distinct(), "touched")
            folders, spans = self.ranges(touched)
            within = F.lit(False)
            for low, high in spans:
                within = within | F.col("z").between(low, high)
            wanted = broadcast_if_bounded(touched, self.lattice.blocks)
            blocks = blocks.where(F.col("part").isin(folders) & within).join(wanted, "z", "left_semi")
            digests = digests.where(within).join(wanted, "z", "left_semi")
        if check and self.info["levels"] > 2:  # else opening has compared them all
            bad = self.wrong_digests(touched).limit(1).collect()
            if bad:
                raise ValueError(f"digest level {bad[0].level} of {self.path} does not match the level above")
        rows = blocks.join(broadcast_if_bounded(digests, self.lattice.blocks), "z", "left").withColumn("found", block_digest(names))
        if not check:
            return rows.drop("part")
        same = F.col("stored").eqNullSafe(F.col("found"))
        return rows.select("z", *PLACE, *FRAME, *[
            F.when(same, F.col(f.name)).otherwise(F.raise_error(F.concat(F.lit("block "), F.col("z").cast("string"), F.lit(
                " does not match its digest"))).cast(f.dataType)).alias(f.name) for f in self.values])

    def wrong_digests(self, touched: DataFrame | None = None) -> DataFrame:
        """``level, z``: digests, in the groups that ``touched`` needs, that do not give the one above them."""
        found = self.spark.createDataFrame([], "level int, z bigint")
        for k in range(self.info["levels"] - 1):
            below, above = self._level(k), self._level(k + 1)
            if touched is not None:
                groups = touched.select(F.shiftright("z", FAN_BITS * (k + 1)).alias("z")).distinct()
                groups = broadcast_if_bounded(groups, 1 + (self.lattice.blocks >> FAN_BITS))
                below = below.withColumn("group", F.shiftright("z", FAN_BITS)).join(groups.withColumnRenamed("z", "group"), "group", "left_semi")
                above = above.join(groups, "z", "left_semi")
            pair = _next_level(below.select("z", "digest")).withColumnRenamed("digest", "made").join(above, "z", "full_outer")
            found = found.unionByName(pair.where(~F.col("made").eqNullSafe(F.col("digest"))).select(F.lit(k).alias("level"), "z"))
        return found

    def damaged(self, touched: DataFrame | None = None) -> DataFrame:
        """``z, face, by, bx``: blocks whose content does not match their digest; without ``touched``, of the whole field."""
        rows = self.read(touched, check=False)
        return rows.where(~F.col("stored").eqNullSafe(F.col("found"))).select("z", *PLACE)


def write_blocks(field: DataFrame, path: str, lattice: Lattice, identity: dict, kind: str = "float",
                 group_bytes: int = 16 << 20) -> BlockStore:
    """Save a node table as blocks; refuses to overwrite and fails on an incomplete field.

    Column metadata (``unit`` and the like) is kept.  The manifest comes last: without it the folder is no field.
    """
    spark = field.sparkSession
    if store.exists(spark, path):
        raise FileExistsError(f"{path} holds a field already")
    values = T.StructType([T.StructField(f.name, T.ArrayType(KINDS[kind]), metadata=f.metadata)
                           for f in field.schema if f.name not in store.CUBE_KEY])
    packed = pack(field, lattice, kind).withColumn("part", F.shiftright("z", lattice.folder_shift).cast("int"))
    (packed.repartitionByRange("z").sortWithinPartitions("z").write.option("parquet.block.size", group_bytes)
     .option("parquet.block.size.row.check.min", 1).partitionBy("part").parquet(f"{path}/field"))
    saved = BlockStore(spark, path, lattice, values, {})
    level, k = saved._table().select("z", block_digest(values.names).alias("digest")), 0
    while True:
        level.sortWithinPartitions("z").write.parquet(f"{path}/digests/level={k}")
        level = saved._level(k)
        rows = level.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("z").alias("keys"), F.first("digest").alias("digest")).first()
        if k == 0 and (rows.rows, rows["keys"]) != (lattice.blocks, lattice.blocks):
            raise ValueError(f"{path}: expected {lattice.blocks} blocks, found {rows.rows}")
        if rows.rows == 1 and k > 0:
            break
        level, k = _next_level(level), k + 1
    info = {**identity, "version": VERSION, "lattice": [lattice.kind, lattice.size, lattice.block],
            "values": json.loads(values.json()), "levels": k + 1, "root": str(rows.digest)}
    store.write_manifest(spark, f"{path}/identity", info)
    return BlockStore(spark, path, lattice, values, info)


def open_blocks(spark: SparkSession, path: str, identity: dict | None = None, units: dict[str, str] | None = None) -> BlockStore:
    """Open a saved field: version, identity, units and the root of its digests are compared; blocks are when they are read."""
    info = store.read_manifest(spark, f"{path}/identity")
    if info.get("version") != VERSION:
        raise ValueError(f"{path} has version {info.get('version')}, not {VERSION}")
    wrong = sorted(k for k, v in (identity or {}).items() if info.get(k) != v)
    if wrong:
        raise ValueError(f"saved field has a different identity: {', '.join(wrong)}")
    values = T.StructType.fromJson(info["values"])
    for name, unit in (units or {}).items():
        if name not in values.names or values[name].metadata.get("unit") != unit:
            raise ValueError(f"{path}: {name} is not stored in {unit}")
    opened = BlockStore(spark, path, Lattice(*info["lattice"]), values, info)
    top = [str(r.digest) for r in opened._level(info["levels"] - 1).collect()]  # one row
    if top != [info["root"]]:
        raise ValueError(f"{path}: the digests do not match the manifest")
    if info["levels"] == 2 and not opened.wrong_digests().isEmpty():
        raise ValueError(f"{path}: the digests of its blocks do not match the manifest")
    return opened
