"""Spelling variants: words one edit apart, found through pivotal grams.

Take a global order of bigrams, rare ones first.  A word's prefix are its first three bigrams in that order (with all that tie
with the third); its pivots are the two of them that do not overlap and have the least total frequency, chosen by dynamic
programming.  One edit spoils one of two disjoint bigrams at most.  So of two near words, the one whose prefix ends earlier in
the order has a pivot in the prefix of the other.  The position limit is exact: with the edit behind it, that bigram keeps its
place from the start and all before it is equal; with the edit before it, it keeps its place from the end and all after it is
equal.  Pivots are joined with prefixes on the bigram and that equal side, and an edit distance verifies what meets.

Rows: null and empty texts have no words; a repeated row counts again; a null id is written as an empty string where it is
hashed.  A tie of two forms goes to the word that is least in code-point order.  Empty tables give an empty result.  Only the
id and the text are read, so other columns may have any name.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, id_and_text, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = r"[a-zÀ-ÿ]"  # once A-Z are lower case: 90 letters, so 8,100 bigrams at most
SLIP = 199  # one occurrence in so many, chosen by its hash, loses a letter


def slipped(run: Column, doc_id: Column, slip: int) -> Column:
    """The run, or the run without one letter where ``slip`` divides the hash of its document and itself."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % slip == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, slip: int = SLIP) -> DataFrame:
    """``word, n``: all words of ``least_length`` letters and ``least_count`` occurrences in the whole texts.

    A shorter run can't become a long word, so runs are matched from that length on.
    """
    runs = id_and_text(docs).select("doc_id", F.explode(F.regexp_extract_all(
        F.translate("text", UPPER, LOWER), F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))).alias("run"))
    words = runs.select(slipped(F.col("run"), F.col("doc_id"), slip).alias("word"))
    return (words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= least_count))


def gram_counts(words: DataFrame) -> dict[str, int]:
    """Occurrences of each bigram in the vocabulary; the letters bound their number."""
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1),
                                               lambda i: F.substring("word", i, F.lit(2)))).alias("gram"))
    return {r.gram: r["count"] for r in grams.groupBy("gram").count().collect()}


def cheapest_disjoint(places: Sequence[int], costs: Sequence[int], wanted: int, width: int = 2) -> list[int]:
    """Of grams at ascending ``places``, the ``wanted`` ones without overlap that cost least in all.

    ``best[k]`` is the least (cost, places) of k disjoint grams among those seen; a gram extends what ended ``width`` before it.
    """
    best: list[list[tuple]] = [[(0, ())] + [(math.inf, ())] * wanted]
    for i, (place, cost) in enumerate(zip(places, costs, strict=True)):
        before = next((j for j in range(i, 0, -1) if places[j - 1] + width <= place), 0)
        row = list(best[-1])
        for k in range(1, wanted + 1):
            spent, chosen = best[before][k - 1]
            row[k] = min(row[k], (spent + cost, (*chosen, place)))
        best.append(row)
    return list(best[-1][wanted][1])


def signature(word: str, rank: dict[str, int], counts: dict[str, int]) -> tuple[list[int], list[int]]:
    """Places of the pivots and of the whole prefix of a word."""
    grams = [word[i:i + 2] for i in range(len(word) - 1)]
    last = sorted(rank[g] for g in grams)[:3][-1]
    prefix = [i for i, g in enumerate(grams) if rank[g] <= last]
    return cheapest_disjoint(prefix, [counts[grams[i]] for i in prefix], 2), prefix


def keys(words: DataFrame) -> DataFrame:
    """``word, n, letters, pivot, side, gram, rest``: a row for each pivot or prefix bigram and side that an edit may leave equal.

    ``letters`` is a bit mask of the letters that occur; an edit changes two bits at most.
    """
    counts = gram_counts(words)
    rank = {g: k for k, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}
    ddl = "word string, n bigint, letters bigint, pivot boolean, side int, gram string, rest string"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pivots, prefix = signature(word, rank, counts)
                mask = 0
                for letter in word:
                    mask |= 1 << ord(letter) % 63
                for pivot, places in ((True, pivots), (False, prefix)):
                    for i in places:
                        out += [(word, n, mask, pivot, 0, word[i:i + 2], word[:i]),
                                (word, n, mask, pivot, 1, word[i:i + 2], word[i + 2:])]
            yield batch_of(out, schema)
    return words.select("word", "n").mapInArrow(run, ddl)


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, n, other, other_n``: both directions of each pair of words exactly one edit apart."""
    rows = stage(keys(words), "grams")
    join = ["side", "gram", "rest"]
    left = rows.where("pivot").select(*join, F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("letters").alias("a_l"))
    right = rows.where("not pivot").select(*join, F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("letters").alias("b_l"))
    alike = (F.bit_count(F.col("a_l").bitwiseXOR(F.col("b_l"))) <= 2) & (F.abs(F.length("a") - F.length("b")) <= 1)
    met = left.join(right, join).where(alike & (F.levenshtein("a", "b", 1) == 1))
    one, two = F.struct(F.col("a").alias("word"), F.col("a_n").alias("n")), F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"))
    pairs = met.select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y")).distinct()
    both = pairs.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("p"))
    return both.select("p.x.word", "p.x.n", F.col("p.y.word").alias("other"), F.col("p.y.n").alias("other_n"))


def roots(links: DataFrame, longest: int) -> DataFrame:
    """``word, root``: forms followed to the last by doubling steps; no chain has more than ``longest`` links."""
    step = stage(links.select("word", F.col("form").alias("root")), "roots")
    reach = 1
    while reach < longest:
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stage(step.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        reach *= 2
    return step


def variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5, slip: int = SLIP) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: each word with the more common word that it is a variant of.

    A form is at least ``ratio`` times as common as its variant, so chains of forms are short and have no cycles.
    """
    words = stage(vocabulary(docs, least_length, least_count, slip), "words")
    near = near_pairs(words).groupBy("word", "n").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("top"))
    formed = -F.col("top.less") >= ratio * F.col("n")
    near = stage(near.select("word", "n_near", F.when(formed, F.col("top.other")).alias("form"),
                             F.when(formed, -F.col("top.less")).alias("form_n")), "near")
    most = words.agg(F.max("n")).first()[0] or least_count
    longest = 0
    while least_count * ratio ** (longest + 1) <= most:
        longest += 1
    last = roots(near.where("form is not null"), longest)
    return (words.join(near, "word", "left").join(last, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n"))
