"""Keyed lookups of many rows in a table with unique keys.

Three physical plans, chosen by what is known about sizes:

* the table's row count is bounded by its grid (a face has ``(n+1)^2`` nodes) and small enough:
  broadcast hash join, no shuffle of the rows;
* otherwise a plain equi-join, which adaptive execution may still turn into a broadcast join from
  measured sizes, or split when one partition is skewed;
* ``spread_hot_keys=True``: keys that hold more than ``hot_share`` of all rows are counted first
  (a partial aggregate) and their rows are spread over ``salts`` sub-keys.  At most
  ``1/hot_share`` keys can be that hot, so the hot-key list has a proven bound.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def broadcast_if_bounded(df: DataFrame, max_rows: int | None, row_bytes: int | None = None) -> DataFrame:
    """Mark ``df`` for broadcast only when its largest possible size is under the limit.

    Without ``row_bytes`` the columns must be of fixed width; others have no bound.
    """
    if max_rows is None:
        return df
    if row_bytes is None:
        if any(t.startswith(("string", "binary", "array", "map", "struct")) for _, t in df.dtypes):
            return df
        row_bytes = 16 + 16 * len(df.columns)
    return F.broadcast(df) if max_rows * row_bytes <= BROADCAST_LIMIT_BYTES else df


def pin(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fix computed columns as plain values of each row.

    A one-element ``inline`` keeps the optimiser from tracing a join key back through its whole
    chain of projections (for partition pruning and filter push-down), where every step would
    repeat the geometry of the one before.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*columns))))


def keyed_lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], *, how: str = "left",
                 max_rows: int | None = None, spread_hot_keys: bool = False,
                 hot_share: float = 1e-3, salts: int = 64) -> DataFrame:
    """Attach the table's columns to every row with the same key."""
    keys = list(keys)
    hinted = broadcast_if_bounded(table, max_rows)
    if hinted is not table or not spread_hot_keys:
        return rows.join(hinted, keys, how)
    total = rows.count()
    hot = (rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
           .where(F.col("__rows") > max(1, int(total * hot_share)))
           .select(*keys, F.lit(True).alias("__hot")))
    hot = F.broadcast(hot)  # at most 1/hot_share rows
    # The place of a row in its partition, so that equal rows of a hot key get different sub-keys too.
    mixed = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    salted = rows.join(hot, keys, "left").withColumn(
        "__salt", F.when(F.col("__hot"), mixed).otherwise(F.lit(0))).drop("__hot")
    copies = table.join(hot, keys, "left").withColumn("__salt", F.explode(
        F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
        .otherwise(F.array(F.lit(0))))).drop("__hot")
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")
