"""Stored fields, tiles and run manifests as Parquet and JSON written by Spark."""
from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CUBE_KEY = ["face", "y", "x"]
BLOCK_KEY = ["face", "by", "bx"]
TILE_KEY = ["face", "ty", "tx"]


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session without one (tests) gets a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise once in shared storage, so a lost executor never recomputes it differently; columns stay prunable."""
    return stage(df, "cut")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table once into the shared folder and read it back: lineage ends and columns stay prunable."""
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def content_checksum(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Order-free checksum of a table: row count, hash sum and hash xor."""
    h = F.xxhash64(*[F.col(c) for c in [*keys, *[c for c in df.columns if c not in keys]]])
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.sum(h.cast("decimal(20,0)")).cast("string").alias("hash_sum"),
                  F.bit_xor(h).alias("hash_xor"))


def portable_checksum(df: DataFrame, keys: Sequence[str], scale: int = 6) -> DataFrame:
    """The same with digests of rounded decimal text, comparable between engines."""
    columns = [*keys, *[c for c in df.columns if c not in keys]]
    types = dict(df.dtypes)

    def text(c):
        if types[c] in ("double", "float"):
            return F.round(F.col(c) * F.lit(float(10 ** scale))).cast("bigint").cast("string")
        return F.col(c).cast("string")
    digest = F.md5(F.concat_ws("|", *[text(c) for c in columns]))
    part = F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.sum(part.cast("decimal(38,0)")).cast("string").alias("digest_sum"))


def record_digest(payload) -> Column:
    return F.sha2(F.col(payload) if isinstance(payload, str) else payload, 256)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()), hpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = file_system(spark, path)
    return fs.exists(hpath)


def write_manifest(spark: SparkSession, path: str, identity: dict) -> None:
    """Create the identity of a run once; a rerun must bring exactly the same one."""
    text = json.dumps(identity, sort_keys=True)
    if exists(spark, path):
        if read_manifest(spark, path) != json.loads(text):
            raise ValueError("the folder belongs to a run with different settings")
        return
    put_text(spark, f"{path}/manifest.json", text)


def put_text(spark: SparkSession, path: str, text: str) -> bool:
    """A small file in the shared storage, complete from the moment it shows; False if there is one already."""
    fs, place = file_system(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(place.getParent().getParent(), f"_draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    fs.mkdirs(place.getParent())
    if not fs.exists(place) and fs.rename(draft, place):
        return True
    fs.delete(draft, False)
    return False


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def manifest_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys whose values differ between two one-row tables with an ``info MAP`` column."""
    a = left.select(F.explode("info").alias("key", "left_value"))
    b = right.select(F.explode("info").alias("key", "right_value"))
    both = a.join(b, "key", "full_outer")
    return both.where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def assert_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Exact column names and types, in order."""
    have = [(f.name, f.dataType.simpleString()) for f in df.schema]
    want = [(f.name, f.dataType.simpleString()) for f in expected]
    if have != want:
        raise ValueError(f"schema {have} does not match {want}")
    return df


def field_schema(values: Sequence[str], keys: Sequence[str] = CUBE_KEY) -> T.StructType:
    return T.StructType([T.StructField(k, T.IntegerType()) for k in keys]
                        + [T.StructField(v, T.FloatType()) for v in values])


def _bad(values: Sequence[str]) -> Column:
    """How many values are missing, not a number or infinite."""
    return sum((F.count_if(F.col(v).isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) for v in values), F.lit(0))


def _survey(df: DataFrame, keys: Sequence[str]) -> dict:
    """Rows, bad values and content hashes of a stored table in one scan."""
    values = [c for c in df.columns if c not in keys]
    h = F.xxhash64(*[F.col(c) for c in [*keys, *values]])
    return df.agg(F.count(F.lit(1)).alias("rows"), _bad(values).alias("bad"),
                  F.sum(h.cast("decimal(20,0)")).cast("string").alias("hash_sum"),
                  F.bit_xor(h).alias("hash_xor")).first().asDict()


def _require_complete(found: dict, rows: int, name: str) -> dict:
    """The content hashes of a stage, if it has all its rows and only finite values."""
    if found["rows"] != rows:
        raise ValueError(f"{name}: expected {rows} rows, found {found['rows']}")
    if found["bad"]:
        raise FloatingPointError(f"{name}: {found['bad']} values are missing or not finite")
    return {k: v for k, v in found.items() if k != "bad"}


def write_cube_field(df: DataFrame, path: str, n: int, identity: dict, block: int = 256) -> DataFrame:
    """Save a cube field as a node table of float32, by face and along rows of blocks.

    Refuses to overwrite.  Returns the saved table.  :mod:`sphereframe.sources.blocks` stores fields for regional reads.
    """
    spark = df.sparkSession
    if exists(spark, path):
        raise FileExistsError(f"{path} holds a field already")
    values = [c for c in df.columns if c not in CUBE_KEY]
    out = df.select(*[F.col(k).cast("int").alias(k) for k in CUBE_KEY],
                    *[F.col(v).cast("float").alias(v) for v in values])
    by, bx = (F.floor(F.col(c) / F.lit(block)) for c in ("y", "x"))
    (out.repartitionByRange("face", by, bx).sortWithinPartitions("face", by, bx, "y", "x")
     .write.mode("errorifexists").partitionBy("face").parquet(f"{path}/field"))
    saved = load_cube_field(spark, path, values)
    content = _require_complete(_survey(saved, CUBE_KEY), 6 * (n + 1) ** 2, path)
    write_manifest(spark, f"{path}/identity", {**identity, "intervals": n, "block": block, "values": values, **content})
    return saved


def load_cube_field(spark: SparkSession, path: str, values: Sequence[str]) -> DataFrame:
    """The table itself, with a fixed schema; :func:`open_run` also verifies it."""
    return spark.read.schema(field_schema(values)).parquet(f"{path}/field").select(*CUBE_KEY, *values)


def write_grid(df: DataFrame, path: str, keys: Sequence[str], block_rows: int = 128) -> None:
    """Save a grid in row blocks: ranges of rows per file, ordered inside."""
    row, col = keys[-2], keys[-1]
    group = F.floor(F.col(row) / F.lit(block_rows))
    (df.repartitionByRange(*keys[:-2], group).sortWithinPartitions(*keys)
     .write.mode("errorifexists").parquet(path))


def write_lonlat_field(df: DataFrame, path: str, h: int, identity: dict) -> DataFrame:
    spark = df.sparkSession
    if exists(spark, path):
        raise FileExistsError(f"{path} holds a field already")
    values = [c for c in df.columns if c not in ("y", "x")]
    out = df.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"),
                    *[F.col(v).cast("float").alias(v) for v in values])
    write_grid(out, f"{path}/field", ["y", "x"])
    saved = load_lonlat_field(spark, path, values)
    content = _require_complete(_survey(saved, ["y", "x"]), (h + 1) * 2 * h, path)
    write_manifest(spark, f"{path}/identity", {**identity, "native_height": h, "values": values, **content})
    return saved


def load_lonlat_field(spark: SparkSession, path: str, values: Sequence[str]) -> DataFrame:
    return spark.read.schema(field_schema(values, ["y", "x"])).parquet(f"{path}/field")


REGION_KEY = ["request_id", "row_i", "col_i"]


def write_region(df: DataFrame, path: str, identity: dict) -> None:
    """Save regional grids at their own bounds and resolution, with the digest of what was written."""
    spark = df.sparkSession
    write_grid(df, f"{path}/grid", REGION_KEY)
    content = _survey(spark.read.schema(df.schema).parquet(f"{path}/grid"), REGION_KEY)
    write_manifest(spark, f"{path}/identity", {**identity, "coverage": "region", **content,
                                               "schema": json.loads(df.schema.json())})


def load_region(spark: SparkSession, path: str) -> DataFrame:
    """Saved regional grids; :func:`sphereframe.operators.quality.verify_region` checks them."""
    schema = T.StructType.fromJson(read_manifest(spark, f"{path}/identity")["schema"])
    return spark.read.schema(schema).parquet(f"{path}/grid")


def write_export(df: DataFrame, path: str, h: int, height: int, identity: dict,
                 window: tuple[int, int, int, int] | None = None) -> None:
    """Save an exported grid with its place: pixel size, edges and window of the global grid."""
    x, y, width, rows = window or (0, 0, 2 * height, height)
    step = 180 / height
    write_manifest(df.sparkSession, f"{path}/identity", {
        **identity, "native_height": h, "export_height": height, "window": [x, y, width, rows],
        "pixel_degrees": step, "west": -180 + x * step, "north": 90 - y * step,
        "east": -180 + (x + width) * step, "south": 90 - (y + rows) * step,
        "sampling": "bilinear at the centre of each pixel"})
    write_grid(df, f"{path}/grid", ["row_i", "col_i"])


def observe_stage(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows and bad values of a stage while it is being written, without another pass."""
    values = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), _bad(values).alias("bad")), seen


def record_stage(df: DataFrame, path: str, keys: Sequence[str], rows: int, name: str) -> DataFrame:
    """Write a stage, read it back (this ends its lineage) and validate it; restore if present."""
    spark = df.sparkSession
    if not exists(spark, path):
        df.write.mode("errorifexists").parquet(path)
    saved = spark.read.schema(df.schema).parquet(path)
    _require_complete(_survey(saved, keys), rows, name)
    return saved


def snapshot_input(df: DataFrame, path: str) -> DataFrame:
    """Keep the validated input beside the results, once."""
    spark = df.sparkSession
    if not exists(spark, path):
        df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_lonlat_run(spark: SparkSession, path: str, identity: dict) -> tuple[DataFrame, dict]:
    """Open a saved longitude/latitude field like :func:`open_run`: identity and content are verified."""
    saved = read_manifest(spark, f"{path}/identity")
    wrong = sorted(k for k, v in identity.items() if saved.get(k) != v)
    if wrong:
        raise ValueError(f"saved field has a different identity: {', '.join(wrong)}")
    field, h = load_lonlat_field(spark, path, saved["values"]), saved["native_height"]
    now = _require_complete(_survey(field, ["y", "x"]), (h + 1) * 2 * h, path)
    if any(saved[k] != v for k, v in now.items()):
        raise ValueError("saved field does not match its checksum")
    return field, saved


def open_run(spark: SparkSession, path: str, identity: dict) -> tuple[DataFrame, dict]:
    """Open a saved cube field for queries; every identity key must match and content be intact."""
    saved = read_manifest(spark, f"{path}/identity")
    wrong = sorted(k for k, v in identity.items() if saved.get(k) != v)
    if wrong:
        raise ValueError(f"saved field has a different identity: {', '.join(wrong)}")
    field = load_cube_field(spark, path, saved["values"])
    now = _require_complete(_survey(field, CUBE_KEY), 6 * (saved["intervals"] + 1) ** 2, path)
    if any(saved[k] != v for k, v in now.items()):
        raise ValueError("saved field does not match its checksum")
    return field, saved
