"""SimHash fingerprints, and all fingerprints within a Hamming radius through permuted block tables."""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, id_and_text

BITS = 64
SHINGLE = 2
RADIUS = 3
BLOCKS, KEEP = 5, 2
MEMBERS = 8192  # fingerprints of a bucket that are compared in one place

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(4096, 0x100000001B3, np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str | bytes) -> np.ndarray:
    """A 64-bit hash for every word of the text; words are separated by white space of ASCII."""
    data = np.frombuffer(text.encode("utf-8", "replace") if isinstance(text, str) else text, np.uint8)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    inside = ~gap
    starts = np.flatnonzero(inside & np.concatenate(([True], gap[:-1]))) if len(data) else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.flatnonzero(inside)
    word = np.searchsorted(starts, at, "right") - 1 if len(at) < 64 else np.cumsum(np.bincount(starts, minlength=len(data)))[at] - 1
    place = at - starts[word]
    terms = (data[at].astype(np.uint64) + np.uint64(1)) * _POWERS[place % len(_POWERS)]
    first = np.searchsorted(at, starts)
    return _mix(np.add.reduceat(terms, first))


def term_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the terms: single words, and runs of ``shingle`` words."""
    w = word_hashes(text)
    if len(w) < shingle:
        return w
    return np.concatenate([w, run_hashes(w, shingle)])


def run_hashes(w: np.ndarray, size: int) -> np.ndarray:
    """A hash for every run of ``size`` words, or one for a shorter text."""
    n = max(1, len(w) - size + 1)
    runs = w[:n].copy()
    for k in range(1, min(size, len(w))):
        runs = _mix(runs * _MULTIPLY + w[k:n + k])
    return runs


def fingerprint(text: str) -> int:
    """64 signed sums over the distinct terms, each weighted with 1 + ln of its count; the signs are the bits."""
    terms = term_hashes(text)
    if not len(terms):
        return 0
    terms, counts = np.unique(terms, return_counts=True)
    weights = (1.0 + np.log(counts)).astype(np.float32)
    votes = np.zeros(BITS)
    for a in range(0, len(terms), 8192):
        bits = np.unpackbits(terms[a:a + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        w = weights[a:a + 8192]
        votes += 2.0 * (w @ bits.astype(np.float32)) - w.sum()
    return int(np.packbits(votes > 0, bitorder="little").view("<u8")[0])


def likeness(a: int, b: int) -> float:
    return 1.0 - (a ^ b).bit_count() / BITS


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (bigint) of every row's whole text; equal texts have equal fingerprints.

    A null or empty text has fingerprint 0; repeated rows each give a row; other columns are not read.
    """
    schema = arrow_schema("doc_id bigint, fingerprint bigint")

    def run(batches):
        for batch in batches:
            doc_id, text = batch.columns
            prints = [np.uint64(fingerprint(text[i].as_py())).astype(np.int64) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(prints, pa.int64())], schema=schema)
    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, fingerprint bigint")


def _masks(blocks: int, keep: int) -> list[int]:
    """The bits that each table keeps: every choice of ``keep`` blocks."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(some) for some in combinations(block, keep)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _table_rows(prints: DataFrame, blocks: int, keep: int) -> DataFrame:
    """The fingerprints once for each table, keyed by the bits that the table keeps."""
    keys = [F.struct(F.lit(k).alias("number"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("key"))
            for k, m in enumerate(_masks(blocks, keep))]
    return prints.select("fingerprint", "copies", F.explode(F.array(*keys)).alias("t")).select("t.*", "fingerprint", "copies")


def near_counts(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, keep: int = KEEP,
                members: int = MEMBERS) -> DataFrame:
    """For every distinct fingerprint: its rows (``copies``) and the rows of other fingerprints within ``radius`` bits.

    With ``blocks - keep >= radius`` two fingerprints within the radius agree on the bits of some table, so nothing is
    missed; a pair counts in the first table that joins it only.  Equal fingerprints are one row beforehand, and pairs
    are counted where they meet, never written.  A bucket of more than ``members`` fingerprints is dealt out to parts of about
    that many, whose pairs are compared in tasks of their own.  The empty table gives an empty table.
    """
    if blocks - keep < radius:
        raise ValueError("too few blocks for this radius")
    masks = np.array(_masks(blocks, keep), np.uint64)
    distinct = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"))

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows["fingerprint"].to_numpy(np.int64).view(np.uint64)
        copies, part = rows["copies"].to_numpy(np.int64), rows["part"].to_numpy()
        number, apart_only = int(rows["number"].iloc[0]), rows["one"].iloc[0] != rows["two"].iloc[0]
        near = np.zeros(len(own), np.int64)
        step = max(1, (1 << 21) // len(own))
        for a in range(0, len(own), step):
            apart = own[a:a + step, None] ^ own[None, :]
            hit = (np.bitwise_count(apart) <= radius) & (apart != 0)
            if apart_only:
                hit &= part[a:a + step, None] != part[None, :]
            for earlier in masks[:number]:
                hit &= (apart & earlier) != 0
            near[a:a + step] = hit @ copies
        met = near > 0
        return pd.DataFrame({"fingerprint": own[met].view(np.int64), "near": near[met]})
    # A bucket of one fingerprint has no pair; it needn't be dealt to Python.  A large one is dealt out to parts, and two
    # parts meet in one place each, so a place holds at most about two parts whatever the bucket's size.
    rows = _table_rows(distinct, blocks, keep)
    buckets = rows.groupBy("number", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "number", "key", F.ceil(F.col("n") / F.lit(members)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fingerprint", F.lit("part")), F.col("parts")).cast("int").alias("part")
    seats = rows.join(buckets, ["number", "key"]).select("number", "key", "fingerprint", "copies", "parts", part)
    seats = seats.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "number", "key", "fingerprint", "copies", "part", F.least("part", "other").alias("one"),
        F.greatest("part", "other").alias("two"))
    found = seats.groupBy("number", "key", "one", "two").applyInPandas(count, "fingerprint bigint, near bigint")
    total = found.groupBy("fingerprint").agg(F.sum("near").alias("near"))
    return distinct.join(total, "fingerprint", "left").select("fingerprint", "copies", F.coalesce("near", F.lit(0)).alias("near"))


def _parts(rows: DataFrame, parts: int) -> DataFrame:
    """``part``: ranges of ascending ids of about equal numbers of rows, nulls in the first."""
    cuts = rows.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else []
    splits = [-math.inf, *sorted(set(cuts)), math.inf]
    if len(splits) < 3:
        return rows.withColumn("part", F.lit(0))
    place = Bucketizer(splits=splits, inputCol="place", outputCol="bucket")
    return (place.transform(rows.withColumn("place", F.coalesce(F.col("doc_id").cast("double"), F.lit(-math.inf))))
            .withColumn("part", F.col("bucket").cast("int")).drop("place", "bucket"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``part, guest, doc_id, text``: the documents in ascending id order, one part to a partition.

    Nulls come first and equal ids are ordered by text.  After its own rows each part holds, as guests, the rows with the
    lowest id of the next part (after the last part: of the first), so the row after every row is at hand.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _parts(id_and_text(docs, id_col, text_col), parts).withColumn("key", F.coalesce("doc_id", F.lit(-1 << 63)))
    first = [tuple(r) for r in rows.groupBy("part").agg(F.min("key")).orderBy("part").collect()]  # a row for each part
    before = [(part, key, first[k - 1][0]) for k, (part, key) in enumerate(first)]
    bounds = docs.sparkSession.createDataFrame(before, "part int, key bigint, host int")
    own = F.struct(F.col("part"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("host").alias("part"), F.lit(True).alias("guest"))
    rows = rows.join(F.broadcast(bounds), ["part", "key"], "left")  # at most one row for each partition
    rows = rows.select(F.explode(F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("at"),
                       "doc_id", "text").select("at.*", "doc_id", "text")
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("guest", "doc_id", "text")


EDITS = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
         "near_edited double, near_next double, print bigint")


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document, and how like they are.

    The edited text has its last half replaced by as many characters from the start of the next document in ascending
    order of ids.  One exchange of the texts; a part streams with two documents in memory.  A null or empty text is empty
    and stays so; a table of one row is its own neighbour; repeated rows each give a row; an empty table gives none.
    """
    schema = arrow_schema(EDITS)

    def pair(doc_id, text, own, after, following):
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        changed = own if edited == text else fingerprint(edited)
        return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), f"{own:016x}",
                f"{changed:016x}", likeness(own, changed), likeness(own, following), _signed(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out = []
            guest, doc_id, text = (batch.column(k) for k in (1, 2, 3))
            for i in range(batch.num_rows):
                if last is not None and last[3]:
                    break  # the guest that follows the last own row has been seen
                now = text[i].as_py()
                now = (doc_id[i].as_py(), now, fingerprint(now), guest[i].as_py())
                if last is not None:
                    out.append(pair(*last[:3], now[1], now[2]))
                last = now
            yield batch_of(out, schema)
    return with_next(docs, id_col, text_col).mapInArrow(run, EDITS)
