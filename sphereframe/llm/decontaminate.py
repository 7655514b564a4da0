"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows."""
from __future__ import annotations

import re
from functools import reduce

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, id_and_text, map_rows, stage

WINDOW = 10
BLOCK_WORDS = 50_000

# Every byte of UTF-8 above 0x7F belongs to a word, and A-Z become a-z, so text of any script is normalised bytewise.
_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RESULT = ("doc_id bigint, n_words bigint, n_hit bigint, items array<string>, "
          "spans array<struct<start:bigint,end:bigint>>")


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split()


def window_keys(text: str, window: int = WINDOW) -> set[str]:
    """The windows of one item, each as its words between single spaces; a short item is one window."""
    parts = words(text)
    return {(b" " + b" ".join(parts[i:i + window]) + b" ").decode("latin-1")
            for i in range(max(1, len(parts) - window + 1))} if parts else set()


def automaton(items: list[tuple[str | None, str]], window: int = WINDOW) -> ahocorasick.Automaton | None:
    owners: dict[str, set] = {}
    for item, text in items:
        for key in window_keys(text, window):
            owners.setdefault(key, set()).add(item)
    if not owners:
        return None
    found = ahocorasick.Automaton()
    for key, ids in owners.items():
        found.add_word(key, (key.count(" ") - 1, ids))
    found.make_automaton()
    return found


Run = tuple[int, int, int, int]


def hits(machine: ahocorasick.Automaton | None, text: str) -> tuple[int, set, list[Run]]:
    """Number of words, items with a window, and maximal runs of hit words: word ranks and code points, ends exclusive."""
    parts = words(text)
    line = (b" " + b" ".join(parts) + b" ").decode("latin-1")
    ends, items = [], set()
    for end, (length, ids) in machine.iter(line) if machine and parts else ():
        ends.append((end, length))
        items |= ids
    if not ends:
        return len(parts), items, []
    # A hit ends at the space after its last word; that space's rank is the number of words up to there.
    rank = np.cumsum(np.frombuffer(line.encode("latin-1"), np.uint8) == 32) - 1
    cover = np.zeros(len(parts) + 1, np.int64)
    for end, length in ends:
        cover[rank[end] - length] += 1
        cover[rank[end]] -= 1
    hit = np.cumsum(cover[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0]))))
    places = [m.span() for m in _WORD.finditer(text)]
    return len(parts), items, [(int(a), int(b), places[a][0], places[b - 1][1])
                               for a, b in zip(edges[::2], edges[1::2], strict=True)]


def merged(runs: list[Run]) -> list[Run]:
    """The maximal runs of the words that any of ``runs`` covers."""
    out: list[Run] = []
    for first, last, start, end in sorted(runs):
        if out and first <= out[-1][1]:
            if last > out[-1][1]:
                out[-1] = (out[-1][0], last, out[-1][2], end)
        else:
            out.append((first, last, start, end))
    return out


def answer(doc_id: int | None, n_words: int, items: set, runs: list[Run]) -> tuple:
    return (doc_id, n_words, sum(b - a for a, b, _, _ in runs), sorted(i for i in items if i is not None),
            [{"start": s, "end": e} for _, _, s, e in runs])


class Benchmark:
    """Benchmark items in blocks of about ``block_words`` words; a block, and no more, is on the driver at a time."""

    def __init__(self, table: DataFrame, block_words: int = BLOCK_WORDS, id_col: str = "item_id", text_col: str = "text"):
        items = table.select(table[id_col].cast("string").alias("item_id"), table[text_col].cast("string").alias("text"))
        self.items = items.where("text is not null").distinct()
        total = self.items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
        self.n = max(1, -(-total // block_words))

    def block(self, k: int) -> list[tuple[str | None, str]]:
        part = F.pmod(F.xxhash64("item_id", "text"), F.lit(self.n))
        return [tuple(r) for r in self.items.where(part == k).collect()]


def _block_hits(rows: DataFrame, benchmark: Benchmark, window: int) -> DataFrame:
    """``digest, items, runs`` of the distinct texts with a window of a block; a pass over ``digest, text`` for each block.

    A task builds its block's automaton once.  Each pass is written before the next block is read, so the memory of driver
    and tasks is that of one block.
    """
    ddl = "digest string, items array<string>, runs array<struct<a:bigint,b:bigint,s:bigint,e:bigint>>"
    schema, passes = arrow_schema(ddl), []
    for k in range(benchmark.n):
        shared = rows.sparkSession.sparkContext.broadcast(benchmark.block(k))  # about block_words words

        def run(batches, shared=shared):
            machine = automaton(shared.value, window)
            for batch in batches:
                out, (digest, text) = [], batch.columns
                for i in range(batch.num_rows):
                    _, items, runs = hits(machine, text[i].as_py())
                    if runs:
                        out.append((digest[i].as_py(), list(items), [dict(zip("abse", r, strict=True)) for r in runs]))
                yield batch_of(out, schema)
        passes.append(stage(rows.mapInArrow(run, ddl).dropDuplicates(["digest"]), "hits"))
        shared.unpersist()
    return reduce(DataFrame.unionByName, passes)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Benchmark passages in whole documents: one row for each row of ``docs``.

    Returns ``doc_id, n_words, n_hit, items`` (sorted ids of items with an occurring window) and ``spans`` (maximal
    runs of hit words as code point offsets in the original text).  A benchmark of one block is one pass without a shuffle;
    of more, one pass for each block, whose hits alone are exchanged, by digest of the text.  A null or empty text has no
    words; repeated rows each give a row; an item with a null text has no window, one with a null id marks words but isn't
    listed; equal item rows count once.  Without items nothing is hit.  Other columns of ``docs`` are not read.
    """
    items, rows = Benchmark(benchmark, block_words), id_and_text(docs, id_col, text_col)
    if items.n == 1:
        shared = docs.sparkSession.sparkContext.broadcast(items.block(0))

        def make():
            machine = automaton(shared.value, window)
            return lambda doc_id, text: answer(doc_id, *hits(machine, text))
        return map_rows(rows, make, RESULT)
    digest = F.md5(F.col("text").cast("binary")).alias("digest")
    found = _block_hits(rows.select(digest, "text"), items, window)
    found = found.groupBy("digest").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
                                        F.flatten(F.collect_list("runs")).alias("runs"))  # at most a row for each block
    counted = map_rows(rows.select("doc_id", digest, "text"), lambda: lambda i, d, t: (i, d, len(words(t))),
                       "doc_id bigint, digest string, n_words bigint")
    return map_rows(counted.join(found, "digest", "left").select("doc_id", "n_words", "items", "runs"), lambda: _joined, RESULT)


def _joined(doc_id, n_words, items, runs):
    return answer(doc_id, n_words, set(items or ()), merged([tuple(r[x] for x in "abse") for r in runs or ()]))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS,
                        text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any benchmark window, with all their columns.  Blocks as in ``scan``."""
    items = Benchmark(benchmark, block_words)
    if items.n > 1:
        digest = F.md5(docs[text_col].cast("string").cast("binary"))
        found = _block_hits(docs.select(digest.alias("digest"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")),
                            items, window).select("digest").distinct()
        return docs.join(found, digest == found["digest"], "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(items.block(0))

    def run(batches):
        machine = automaton(shared.value, window)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter([not hits(machine, texts[i].as_py() or "")[2] for i in range(batch.num_rows)])
    return docs.mapInArrow(run, docs.schema)
