"""Turns of conversations in order, with running values, where one conversation may hold a third of all rows.

Rows are range-partitioned by conversation and turn, so a long conversation lies in several neighbouring parts.  Each part
runs over its sorted rows once; what it must know of earlier parts is one small value of an associative kind for each
conversation that crosses a border: no more values than parts, and they alone pass the driver.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, stage

State = tuple[int, ...]


def select(conversations: DataFrame) -> DataFrame:
    """The four columns that are read, so that others may have any name; a null role or text is empty."""
    return conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                                *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])


def nothing(before: State, *_) -> State:
    return before


def running(rows: DataFrame, order: Sequence[str], unit: State = (), step: Callable[..., State] = nothing,
            merge: Callable[[State, State], State] = nothing) -> DataFrame:
    """``rows`` (conv_id, role, text and more) with ``pos``, from 0 in each conversation, and ``state``.

    The state is ``step`` folded from ``unit`` over the rows of the conversation up to this one; ``merge`` joins the
    states of two neighbouring stretches and must be associative.  Ties of ``order`` go by role, then text.
    """
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    local, final = f"{ddl}, part int, pos bigint, state array<bigint>", f"{ddl}, pos bigint, state array<bigint>"
    local_schema, final_schema = arrow_schema(local), arrow_schema(final)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        at, pos, state = object(), 0, unit
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("conv_id", "role", "text")]
            places, states = [], []
            for conv, role, text in zip(*columns, strict=True):
                if conv != at:
                    at, pos, state = conv, 0, unit
                state = step(state, role, text)
                places.append(pos)
                states.append(list(state))
                pos += 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64()),
                 pa.array(states, pa.list_(pa.int64()))], schema=local_schema)

    place = [F.col("conv_id"), *[F.col(c).asc_nulls_first() for c in order], F.col("role")]
    parts = stage(rows.repartitionByRange(*place, F.substring("text", 1, 64))
                  .sortWithinPartitions(*place, "text").mapInArrow(run, local), "turns")
    pieces = parts.groupBy("conv_id", "part").agg(F.max(F.struct("pos", "state")).alias("last"))
    split = pieces.groupBy("conv_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("conv_id").alias("id"))
    crossing = pieces.join(split, F.col("conv_id").eqNullSafe(F.col("id")), "left_semi")
    carry, done = {}, {}
    for r in sorted(crossing.collect(), key=lambda r: r.part):
        count, state = done.get(r.conv_id, (0, unit))
        carry[r.conv_id, r.part] = count, state
        done[r.conv_id] = count + r.last.pos + 1, merge(state, tuple(r.last.state))

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, places, states = (batch.column(n).to_pylist() for n in ("conv_id", "part", "pos", "state"))
            for i, key in enumerate(zip(ids, numbers, strict=True)):
                if key in carry:
                    count, state = carry[key]
                    places[i] += count
                    states[i] = list(merge(state, tuple(states[i])))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(places, pa.int64()), pa.array(states, pa.list_(pa.int64()))],
                schema=final_schema)
    return parts.mapInArrow(carried, final)
