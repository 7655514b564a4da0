"""Small helpers that the document operators share."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager, nullcontext

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that other columns of any name can't clash.  A null text is empty."""
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"),
                       F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder of the session."""
    return f"{store.checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, at_once: int | None = None) -> DataFrame:
    """Write a table once in shared storage and read it back: lineage ends there, columns stay prunable.

    ``at_once``: see :func:`rows_at_once`.
    """
    path = scratch(df.sparkSession, name)
    with rows_at_once(df.sparkSession, at_once) if at_once else nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_schema(ddl: str) -> pa.Schema:
    """For the driver: tasks can't parse DDL and take the result along."""
    kinds = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.FloatType: pa.float32(),
             T.StringType: pa.string(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary()}

    def arrow(t: T.DataType) -> pa.DataType:
        if isinstance(t, T.ArrayType):
            return pa.list_(arrow(t.elementType))
        if isinstance(t, T.StructType):
            return pa.struct([(f.name, arrow(f.dataType)) for f in t])
        return kinds[type(t)]
    return pa.schema([(f.name, arrow(f.dataType)) for f in T.StructType.fromDDL(ddl)])


def map_rows(df: DataFrame, make: Callable[[], Callable[..., tuple]], ddl: str) -> DataFrame:
    """Row-wise Python over Arrow batches: ``make()`` runs once in a task and returns row -> row of ``ddl``.

    Values become Python objects one row at a time, so memory is bounded by one Arrow batch.
    """
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()
        for batch in batches:
            columns = batch.columns
            yield batch_of([row(*[c[i].as_py() for c in columns]) for i in range(batch.num_rows)], schema)
    return df.mapInArrow(run, ddl)


@contextmanager
def rows_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """Actions inside give Python at most so many rows in one Arrow batch, for tables whose rows are megabytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, old)


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch one at a time, for rows that are large."""
    for i in range(batch.num_rows):
        yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}


def batch_of(rows: Sequence[Sequence], schema: pa.Schema) -> pa.RecordBatch:
    columns: Iterable = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)],
                                      schema=schema)
