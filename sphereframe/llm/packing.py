"""Lexical retrieval packing: a sharded BM25 index fills every window with a seed document's unused neighbours."""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, id_and_text, stage
from .tokens import encoder

WINDOW = 2048
SHARD_IDS = 1 << 20
K1, B = 1.2, 0.75
TOGETHER = 100
KEY_IDS = 1 << 18  # ids whose keys are computed at once
COMMON = 4         # a term in more than one of this many documents of a shard is held as a dense row
PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, ids binary")
KEYS = 3


def encoded(docs: DataFrame, tokenizer: str, pieces: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, ids``: the ids of each text with its end, see :func:`unpack`."""
    ddl = "doc_id bigint, n bigint, ids binary"
    schema = arrow_schema(ddl)

    def run(batches):
        coder = encoder(tokenizer, pieces)
        for batch in batches:
            doc_id, text = batch.columns
            for a in range(0, batch.num_rows, TOGETHER):
                some = range(a, min(a + TOGETHER, batch.num_rows))
                out = []
                for i, ids in zip(some, coder.many([text[i].as_py() for i in some]), strict=True):
                    ids = np.append(ids, np.uint32(end_id))
                    out.append((doc_id[i].as_py(), len(ids), _pack(ids)))
                yield batch_of(out, schema)
    return id_and_text(docs, id_col, text_col).mapInArrow(run, ddl)


def _pack(ids: np.ndarray) -> bytes:
    """Two bytes an id where they fit, after a byte that says so."""
    wide = "<u4" if len(ids) and int(ids.max()) > 0xFFFF else "<u2"
    return bytes([int(wide[-1])]) + ids.astype(wide).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


def statistics(rows: DataFrame) -> tuple[np.ndarray, float]:
    """Document frequency of every id, and the mean length, over all documents; as large as the vocabulary."""
    ddl = "term bigint, n bigint"
    schema = arrow_schema(ddl)

    def run(batches):
        counts = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for data in batch.column(0):
                seen = np.unique(unpack(data.as_buffer().to_pybytes()))
                if len(seen) and seen[-1] >= len(counts):
                    counts = np.concatenate([counts, np.zeros(int(seen[-1]) + 1 - len(counts), np.int64)])
                counts[seen] += 1
        terms = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(counts[terms], pa.int64())], schema=schema)
    got = rows.select("ids").mapInArrow(run, ddl).groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    whole = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("ids")).first()
    count = whole["rows"] or 0
    df = np.zeros(int(got["term"].max()) + 1 if len(got) else 1)
    df[got["term"].to_numpy(np.int64)] = got["n"]
    return np.log1p((count - df + 0.5) / (df + 0.5)).astype(np.float32), (whole["ids"] or 0) / max(1, count)


def clocks(terms: int) -> np.ndarray:
    """Exponential variates of every term, a row for each key; the same in every task."""
    return np.random.default_rng(7).exponential(size=(KEYS, terms))


def near_keys(docs: list[np.ndarray], idf: np.ndarray, mean: float, clock: np.ndarray) -> np.ndarray:
    """A row of keys for each document: terms drawn in proportion to the square of their BM25 weight.

    Draws of different documents agree (the least of clock / weight^2), so two documents share a key the more often, the
    more of their weight is on common terms, and copies always do.
    """
    sizes = np.array([len(d) for d in docs])
    owner = np.repeat(np.arange(len(docs)), sizes)
    found, tf = np.unique(np.concatenate(docs).astype(np.int64) | owner << 32, return_counts=True)
    term, doc = found & 0xFFFFFFFF, found >> 32
    weight = _weight(idf[term], tf, sizes[doc], mean)
    starts = np.searchsorted(doc, np.arange(len(docs)))
    keys = np.empty((len(docs), len(clock)), np.int64)
    for k, row in enumerate(clock):
        time = row[term] / (weight * weight)
        hit = np.flatnonzero(time == np.minimum.reduceat(time, starts)[doc])
        keys[:, k] = term[hit[np.searchsorted(doc[hit], np.arange(len(docs)))]]
    return keys


def _weight(idf: np.ndarray, tf: np.ndarray, size: np.ndarray, mean: float) -> np.ndarray:
    return idf.astype(np.float64) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / max(mean, 1.0)))


class Index:
    """BM25 inverted index of one shard, whose terms are token ids.

    Terms of many documents are rows of a dense matrix, the others lists of postings; a query uses all terms of its document.
    """

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        sizes = np.array([len(d) for d in docs])
        owner = np.repeat(np.arange(len(docs)), sizes)
        keys, tf = np.unique(np.concatenate(docs).astype(np.int64) * len(docs) + owner, return_counts=True)
        term, self.doc = np.divmod(keys, len(docs))
        self.weight = _weight(idf[term], tf, sizes[self.doc], mean)
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        self.ends = np.append(starts, len(term))
        df = np.diff(self.ends)
        self.n, slot = len(docs), np.repeat(np.arange(len(df)), df)
        common = df * COMMON > self.n
        self.row = np.where(common, np.cumsum(common) - 1, -1)  # of a common term in the matrix
        self.dense = np.zeros((int(common.sum()), self.n))
        self.dense[self.row[slot[common[slot]]], self.doc[common[slot]]] = self.weight[common[slot]]
        order = np.argsort(self.doc, kind="stable")
        self.slots, self.of = slot[order], np.searchsorted(self.doc[order], np.arange(self.n + 1))

    def scores(self, k: int) -> np.ndarray:
        """BM25 of every document of the shard for the query of all distinct terms of document ``k``."""
        terms = self.slots[self.of[k]:self.of[k + 1]]
        rows = self.row[terms]
        asked = np.zeros(len(self.dense))
        asked[rows[rows >= 0]] = 1
        terms = terms[rows < 0]
        a, size = self.ends[terms], self.ends[terms + 1] - self.ends[terms]
        at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return asked @ self.dense + np.bincount(self.doc[at], self.weight[at], self.n)


class Windows:
    """Fills windows one after another; documents are cut where a window is full."""

    def __init__(self, size: int, first: int, with_ids: bool):
        self.size, self.sequence, self.offset, self.with_ids, self.rows = size, first, 0, with_ids, []
        self.tail: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            take = min(self.size - self.offset, len(ids) - at)
            self.tail.append((doc_id, at, ids[at:at + take], len(ids)))
            at, self.offset = at + take, self.offset + take
            if self.offset == self.size:
                self._close(self.tail)
                self.tail, self.offset = [], 0

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, offset,
                              _pack(ids) if self.with_ids else None))
            offset += len(ids)
        self.sequence += 1

    def finish(self) -> None:
        """The last, partly filled window becomes sequences of powers of two, so nothing is padded."""
        left = self.offset
        while left:
            size, some = 1 << (left.bit_length() - 1), []
            left -= size
            while size:
                doc_id, start, ids, total = self.tail.pop(0)
                some.append((doc_id, start, ids[:size], total))
                if len(ids) > size:
                    self.tail.insert(0, (doc_id, start + size, ids[size:], total))
                size -= min(size, len(ids))
            self._close(some)


def fill(docs: list[tuple[int | None, np.ndarray]], idf: np.ndarray, mean: float, windows: Windows) -> None:
    """Greedy: the document that a window starts with, or else the next unused one, is the seed; its best unused
    neighbours follow until the window is full."""
    index, used, following = Index([d for _, d in docs], idf, mean), np.zeros(len(docs), bool), 0
    last = None
    while True:
        if last is None or windows.offset == 0:
            while following < len(docs) and used[following]:
                following += 1
            if following == len(docs):
                return
            last, used[following] = following, True
            windows.add(*docs[following])
            if windows.offset == 0:
                continue
        scores = index.scores(last)
        scores[used] = -1.0
        best, full = np.argsort(-scores, kind="stable"), windows.sequence
        for k in best[:int((~used).sum())]:
            used[k] = True
            windows.add(*docs[k])
            last = int(k)
            if windows.sequence != full:  # the rest of this document seeds the next window
                break
        else:
            return


def pack(docs: DataFrame, tokenizer: str, pieces: str, end_id: int = 1, window: int = WINDOW, shard_ids: int = SHARD_IDS,
         with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of ``window`` ids: every id lies in one piece, offsets have no gap.

    Documents with like vocabularies are brought together by range of vocabulary keys (see :func:`near_keys`; a hot key is
    split by further keys and the id), shards of ``shard_ids`` ids get a BM25 index with statistics of the whole corpus, and
    only the last window of a partition is not full; it becomes sequences of powers of two.  A null or empty text is its end
    id; repeated rows are packed each; an empty table gives none; other columns are not read.  ``ids`` (see ``unpack``) is
    null unless ``with_ids``.
    """
    rows = stage(encoded(docs, tokenizer, pieces, end_id, id_col, text_col), "encoded")
    shared = docs.sparkSession.sparkContext.broadcast(statistics(rows))  # a float for each id of the vocabulary
    key_ddl = "doc_id bigint, k1 bigint, k2 bigint, k3 bigint, ids binary"
    key_schema = arrow_schema(key_ddl)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean = shared.value
        clock = clocks(len(idf))
        for batch in batches:
            first, some, count = 0, [], 0
            for i, data in enumerate(batch.column(1)):
                some.append(unpack(data.as_buffer().to_pybytes()))
                count += len(some[-1])
                if count >= KEY_IDS or i + 1 == batch.num_rows:
                    part, keys = batch.slice(first, len(some)), near_keys(some, idf, mean, clock)
                    yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, keys.T), part.column(1)], schema=key_schema)
                    first, some, count = i + 1, [], 0
    schema = arrow_schema(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean = shared.value
        windows = Windows(window, TaskContext.get().partitionId() << 32, with_ids)
        held, count = [], 0
        for batch in batches:
            doc_id, ids = batch.columns
            for i in range(batch.num_rows):
                held.append((doc_id[i].as_py(), unpack(ids[i].as_buffer().to_pybytes())))
                count += len(held[-1][1])
                if count >= shard_ids:
                    fill(held, idf, mean, windows)
                    yield batch_of(windows.rows, schema)
                    windows.rows, held, count = [], [], 0
        if held:
            fill(held, idf, mean, windows)
        windows.finish()
        yield batch_of(windows.rows, schema)
    near = rows.select("doc_id", "ids").mapInArrow(keyed, key_ddl).repartitionByRange("k1", "k2", "k3", "doc_id").sortWithinPartitions("k1", "k2", "k3", "doc_id", "ids")
    return near.select("doc_id", "ids").mapInArrow(run, PIECES)
