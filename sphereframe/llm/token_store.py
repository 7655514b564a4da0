"""Token ids in shards compressed by Re-Pair: frequent id pairs become nonterminals of the shard's grammar.

File format: Parquet files, one row for each shard, in ascending document order.  A shard holds whole documents: their
ids and lengths, the symbols of all documents, the rules (a pair of symbols each), and the expansion length of every
rule, which lets a reader find any position of a document without decoding what lies before it.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, id_and_text, rows_of
from .tokens import encoder

SHARD_IDS = 1 << 19
TOGETHER = 100     # documents that are encoded together
LEAST = 4          # occurrences from which a pair becomes a rule
LEAST_GAIN = 0.03  # share of the symbols that a round must save for another to follow
SHARDS = ("part bigint, seq bigint, n_ids bigint, doc_ids array<bigint>, n_tokens array<bigint>, n_symbols array<bigint>, "
          "base bigint, symbols binary, rules binary, lengths binary")
_TABLE_BITS = 18


def _hash(keys: np.ndarray, turn: int) -> np.ndarray:
    odd = np.uint64((0x9E3779B97F4A7C15 + 2 * turn * 0x632BE59BD9B4E019) % (1 << 64) | 1)
    return ((keys * odd) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


def compress(ids: np.ndarray, sizes: np.ndarray, base: int, most_rules: int
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, symbols per document, rules and expansion lengths.

    Every round counts all adjacent pairs within documents, ranks the frequent ones and replaces those occurrences that
    no better-ranked pair overlaps; the next round sees the new symbols.
    """
    s = ids.astype(np.uint32)
    last = np.zeros(len(s), bool)  # no pair may begin at the last symbol of a document
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    rules, lengths, n_rules, turn = [], [np.ones(0, np.int64)], 0, 0
    while len(s) > 2 and n_rules < most_rules:
        keys = (s[:-1].astype(np.uint64) << np.uint64(32)) | s[1:]
        slots = _hash(keys, turn)
        slots[last[:-1]] = 0
        counts = np.bincount(slots, minlength=1 << _TABLE_BITS)
        frequent = (counts[slots] >= LEAST) & ~last[:-1]  # a slot counts at least as often as each of its pairs
        pairs, n = np.unique(keys[frequent], return_counts=True)
        pairs, n = pairs[n >= LEAST], n[n >= LEAST]
        order = np.argsort(-n, kind="stable")[:most_rules - n_rules]
        pairs = pairs[order]
        # One pair for each slot of the table; a pair that finds its slot taken waits for a later round.
        pair_slots = _hash(pairs, turn)
        _, first = np.unique(pair_slots, return_index=True)
        pairs = pairs[np.sort(first)]
        if not len(pairs):
            break
        taken = np.zeros(1 << _TABLE_BITS, np.uint64)
        ranks = np.full(1 << _TABLE_BITS, -1, np.int32)
        pair_slots = _hash(pairs, turn)
        taken[pair_slots], ranks[pair_slots] = pairs, np.arange(len(pairs), dtype=np.int32)
        none = np.int32(2 ** 31 - 1)
        rank = np.where(frequent & (taken[slots] == keys), ranks[slots], none)
        rank[rank < 0] = none
        repeat = np.flatnonzero((rank[1:] == rank[:-1]) & (rank[1:] != none)) + 1
        if len(repeat):  # in a run of one symbol every other pair overlaps the one before
            starts = np.flatnonzero(np.diff(repeat, prepend=-2) != 1)
            place = np.arange(len(repeat)) - np.repeat(starts, np.diff(np.append(starts, len(repeat))))
            rank[repeat[place % 2 == 0]] = none
        chosen = rank != none
        chosen[1:] &= rank[1:] < rank[:-1]
        chosen[:-1] &= rank[:-1] < rank[1:]
        used = np.bincount(rank[chosen], minlength=len(pairs))
        number = np.where(used >= LEAST - 1, np.cumsum(used >= LEAST - 1) - 1, -1)
        at = np.flatnonzero(chosen)
        new = number[rank[at]]
        at, new = at[new >= 0], new[new >= 0]
        if not len(at):
            break
        pairs = pairs[number >= 0]
        left, right = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        known = np.concatenate(lengths)
        lengths.append(sum(np.where(x < base, 1, known[np.maximum(x - base, 0)] if len(known) else 1) for x in (left, right)))
        rules.append(np.stack([left, right], axis=1).astype(np.uint32))
        s = s.copy()
        s[at] = (base + n_rules + new).astype(np.uint32)
        last[at] |= last[at + 1]
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        before = len(s)
        s, last = s[keep], last[keep]
        n_rules, turn = n_rules + len(pairs), turn + 1
        if before - len(s) < LEAST_GAIN * before:
            break
    n_symbols = np.zeros(len(sizes), np.int64)
    n_symbols[sizes > 0] = np.diff(np.flatnonzero(last), prepend=-1)
    return s, n_symbols, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), np.concatenate(lengths)


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for, one level of the grammar at a time."""
    s = symbols.astype(np.int64)
    while (big := s >= base).any():
        ends = np.cumsum(1 + big)
        out = np.repeat(s, 1 + big)
        pair = rules[s[big] - base].astype(np.int64)
        out[ends[big] - 2], out[ends[big] - 1] = pair[:, 0], pair[:, 1]
        s = out
    return s.astype(np.uint32)


class Shard:
    """One decoded row of the file format."""

    def __init__(self, row: dict):
        wide = np.uint16 if len(row["rules"]) // 8 + row["base"] <= 1 << 16 else np.uint32
        self.doc_ids, self.base = row["doc_ids"], row["base"]
        self.n_tokens = np.array(row["n_tokens"], np.int64)
        self.at = np.concatenate(([0], np.cumsum(np.array(row["n_symbols"], np.int64)))).astype(np.int64)
        self.symbols = np.frombuffer(row["symbols"], wide)
        self.rules = np.frombuffer(row["rules"], np.uint32).reshape(-1, 2)
        self.lengths = np.frombuffer(row["lengths"], np.uint32)

    def documents(self) -> Iterator[np.ndarray]:
        ids = expand(self.symbols, self.rules, self.base)
        ends = np.cumsum(self.n_tokens)
        for a, b in zip(ends - self.n_tokens, ends, strict=True):
            yield ids[a:b]

    def ids(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard's document ``k``: only the symbols over that range are expanded."""
        s = self.symbols[self.at[k]:self.at[k + 1]].astype(np.int64)
        stop = int(self.n_tokens[k]) if stop is None else min(stop, int(self.n_tokens[k]))
        if stop <= start:
            return np.zeros(0, np.uint32)
        size = np.where(s < self.base, 1, self.lengths[np.maximum(s - self.base, 0)] if len(self.lengths) else 1)
        ends = np.cumsum(size)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skip = start - int(ends[a] - size[a])
        return expand(s[a:b], self.rules, self.base)[skip:skip + stop - start]


def write(docs: DataFrame, path: str, tokenizer: str, pieces: str, end_id: int = 0, shard_ids: int = SHARD_IDS,
          id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts, append ``end_id`` to each, and write shards in ascending document order.

    A null or empty text is its end alone; null ids come first; rows that share an id are ordered by text.  A shard closes
    at ``shard_ids`` ids, so a task holds one shard (or one longer document).  Other columns are not read.
    """
    schema = arrow_schema(SHARDS)

    def run(batches):
        coder = encoder(tokenizer, pieces)
        base = coder.tokenizer.get_vocab_size()
        part, seq, held, parts, names = TaskContext.get().partitionId(), 0, 0, [], []

        def shard():
            ids, sizes = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
            s, n_symbols, rules, lengths = compress(ids, sizes, base, max(0, (1 << 16) - base) or 1 << 16)
            wide = np.uint16 if base + len(rules) <= 1 << 16 else np.uint32
            return batch_of([(part, seq, len(ids), names, sizes.tolist(), n_symbols.tolist(), base,
                              s.astype(wide).tobytes(), rules.tobytes(), lengths.astype(np.uint32).tobytes())], schema)
        for batch in batches:
            doc_id, text = batch.columns
            for a in range(0, batch.num_rows, TOGETHER):
                some = range(a, min(a + TOGETHER, batch.num_rows))
                for i, ids in zip(some, coder.many([text[i].as_py() for i in some]), strict=True):
                    names.append(doc_id[i].as_py())
                    parts.append(np.append(ids, np.uint32(end_id)))
                    held += len(ids) + 1
                    if held >= shard_ids:
                        yield shard()
                        seq, held, parts, names = seq + 1, 0, [], []
        if parts:
            yield shard()
    ordered = id_and_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SHARDS).write.parquet(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """``part, seq, start``: how many ids lie before each shard, from the small columns only."""
    shards = spark.read.parquet(path).select("part", "seq", "n_ids")
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    inside = Window.partitionBy("part").orderBy("seq")
    return shards.join(before, "part").select(
        "part", "seq", (F.col("before") + F.sum("n_ids").over(inside) - F.col("n_ids")).alias("start"))


def map_documents(spark: SparkSession, path: str, fn: Callable[[np.ndarray], tuple], fields: str) -> DataFrame:
    """``doc_id, start, n_tokens`` and what ``fn`` makes of the decoded ids, for every stored document."""
    schema = arrow_schema("doc_id bigint, start bigint, n_tokens bigint, " + fields)

    def run(batches):
        for batch in batches:
            for row in rows_of(batch):
                shard, at, out = Shard(row), row["start"], []
                for name, ids in zip(shard.doc_ids, shard.documents(), strict=True):
                    out.append((name, at, len(ids), *fn(ids)))
                    at += len(ids)
                yield batch_of(out, schema)
    rows = spark.read.parquet(path).join(starts(spark, path), ["part", "seq"])
    return rows.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, " + fields)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Every stored document with its ids."""
    return map_documents(spark, path, lambda ids: (ids.tolist(),), "ids array<bigint>")


def read_ranges(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Random access: ids ``first`` to ``stop`` of the documents in ``wanted (doc_id, first, stop)``.

    Only wanted symbols are expanded.
    """
    ddl = "doc_id bigint, first bigint, stop bigint, ids array<bigint>"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for row in rows_of(batch):
                shard = Shard(row)
                yield batch_of([(w["doc_id"], w["first"], w["stop"],
                                 shard.ids(w["k"], w["first"], w["stop"]).tolist()) for w in row["wanted"]], schema)
    shards = spark.read.parquet(path)
    places = shards.select("part", "seq", F.posexplode("doc_ids").alias("k", "doc_id")).join(wanted, "doc_id")
    asked = places.groupBy("part", "seq").agg(F.collect_list(F.struct("doc_id", "k", "first", "stop")).alias("wanted"))
    return shards.join(asked, ["part", "seq"]).mapInArrow(run, ddl)
