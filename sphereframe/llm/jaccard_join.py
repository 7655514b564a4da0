"""N-gram Jaccard self-join: a MinHash LSH forest proposes, exact shingle sets decide.

A tree of the forest is the sorted trie of its part of the signatures.  Prefixes are shortened from full depth until the
chance that a pair at the threshold shares one in some tree reaches the target recall; documents under a common prefix
are candidates.  Equal texts are one row from the start.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, id_and_text, stage
from .decontaminate import _FOLD
from .fingerprints import run_hashes, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
TREES, DEPTH = 16, 8
BLOCK = 1 << 18  # shingles of one side of a verification block
MEMBERS = 2000   # texts of one side, whose pairs a block holds as arrays

_RNG = np.random.default_rng(20)
_A = (_RNG.integers(0, 1 << 31, TREES * DEPTH) * 2 + 1).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, TREES * DEPTH).astype(np.uint32)
_PLACES = _RNG.integers(1, 1 << 62, DEPTH).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_length(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix that a pair at the threshold shares in some tree with probability ``recall``."""
    depth = DEPTH
    while depth > 1 and 1 - (1 - threshold ** depth) ** TREES < recall:
        depth -= 1
    return depth


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word runs; fewer words make one run, no words none.

    Words are runs of letters and digits, A-Z in lower case, as in decontamination.
    """
    w = word_hashes(text.encode("utf-8", "replace").translate(_FOLD))
    return np.unique(run_hashes(w, size)) if len(w) else np.zeros(0, np.uint64)


def signature(grams: np.ndarray) -> np.ndarray:
    """MinHash values, a row for each tree."""
    low = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    x = (grams >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(x), 1024):
        low = np.minimum(low, (x[a:a + 1024, None] * _A + _B).min(axis=0))
    return low.reshape(TREES, DEPTH)


def prefixes(sign: np.ndarray, depth: int) -> np.ndarray:
    """One 64-bit key for the first ``depth`` values of every tree."""
    with np.errstate(over="ignore"):
        mixed = ((sign[:, :depth].astype(np.uint64) + np.uint64(1)) * _PLACES[:depth]).sum(axis=1, dtype=np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(32))).astype(np.int64)


def _signed_rows(docs: DataFrame, depth: int, shingle: int) -> DataFrame:
    """``doc_id, digest, n, keys``: digest of the text, number of shingles, and the prefix key in each tree."""
    ddl = "doc_id bigint, digest string, n bigint, keys array<bigint>"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            out = []
            doc_id, text = batch.columns
            for i in range(batch.num_rows):
                body = text[i].as_py()
                grams = shingles(body, shingle)
                keys = prefixes(signature(grams), depth).tolist() if len(grams) else []
                out.append((doc_id[i].as_py(), hashlib.md5(body.encode("utf-8", "replace")).hexdigest(), len(grams), keys))
            yield batch_of(out, schema)
    return docs.mapInArrow(run, ddl)


def _links(sets: list[np.ndarray], keys: np.ndarray, tree: int, sides: np.ndarray | None, threshold: float) -> np.ndarray:
    """Which pairs of a block are links that no earlier tree has found.

    Shared shingles are counted by matrix products over the shingles that at least two sets hold.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    if m == 2:
        shared = np.zeros((2, 2))
        shared[0, 1] = shared[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
    else:
        values, place = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(m), sizes.astype(np.int64))
        often = np.bincount(place, minlength=len(values)) >= 2
        column = np.cumsum(often) - 1
        use = often[place]
        owner, place = owner[use], column[place[use]]
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        shared, width = np.zeros((m, m)), max(256, (1 << 22) // m)
        for a in range(0, int(often.sum()), width):
            lo, hi = np.searchsorted(place, [a, a + width])
            x = np.zeros((m, min(width, int(often.sum()) - a)), np.float32)
            x[owner[lo:hi], place[lo:hi] - a] = 1
            shared += x @ x.T
    linked = shared * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-9
    np.fill_diagonal(linked, False)
    if sides is not None:
        linked &= sides[:, None] != sides[None, :]
    for t in range(tree):
        linked &= keys[:, None, t] != keys[None, :, t]
    return linked


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each member the first member of its component."""
    root = np.arange(len(linked))
    while True:
        low = np.where(linked, root[None, :], len(root)).min(axis=1)
        now = np.minimum(root, low)
        now = now[now]
        if (now == root).all():
            return root
        root = now


def _verify(batches: Iterator[pa.RecordBatch], schema: pa.Schema, threshold: float) -> Iterator[pa.RecordBatch]:
    """Blocks arrive whole and one after another; a block's links become counts and a spanning forest."""
    key, held = None, []

    def block():
        names, copies, blocks, keys, sets = zip(*held, strict=True)
        tree, _, one, two = key
        linked = _links([np.frombuffer(s, np.uint64) for s in sets], np.array(keys), tree,
                        np.array(blocks) if one != two else None, threshold)
        counts, roots = linked @ np.array(copies, np.int64), _roots(linked)
        return [(names[i], int(counts[i]), names[roots[i]]) for i in np.flatnonzero(linked.any(axis=1))]
    for batch in batches:
        out = []
        columns = batch.columns
        for i in range(batch.num_rows):
            row = [c[i].as_py() for c in columns]
            if tuple(row[:4]) != key:
                if len(held) > 1:
                    out += block()
                key, held = tuple(row[:4]), []
            held.append(row[4:])
        yield batch_of(out, schema)
    if len(held) > 1:
        yield batch_of(block(), schema)


def _classes(edges: DataFrame) -> DataFrame:
    """``digest, root``: the least digest of every connected component.

    Each round takes the least label among neighbours, then the label's own label; tables are written between rounds.
    """
    both = stage(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("low")).select(
        F.col("a").alias("digest"), F.least("a", "low").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("digest").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("low"))
        now = labels.join(near.withColumnRenamed("a", "digest"), "digest").select(
            "digest", F.col("root").alias("before"), F.least("root", "low").alias("root"))
        up = labels.select(F.col("digest").alias("root"), F.col("root").alias("higher"))
        now = stage(now.join(up, "root").select("digest", "before", F.least("root", "higher").alias("root")), "labels")
        labels = now.select("digest", "root")
        if now.where("root != before").isEmpty():
            return labels


def _parts(block: int = BLOCK, members: int = MEMBERS) -> Column:
    """Into how many parts a bucket of ``members`` texts with ``size`` shingles is dealt."""
    return F.greatest(F.ceil(F.col("size") / F.lit(block)), F.ceil(F.col("members") / F.lit(members))).cast("int")


def groups(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, shingle: int = SHINGLE,
           block: int = BLOCK, members: int = MEMBERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest, class_id, links, root`` for every row of ``docs``.

    ``links`` counts the other rows whose text is equal or has a Jaccard similarity of at least ``threshold`` on word
    shingles; ``class_id`` is the least doc_id of the rows connected by links (null where no member has an id); ``root`` names
    the class itself, because several classes may have the same least id.  A null
    text is empty; texts without words are linked to equal texts only.  Repeated rows each give a row and count as links
    of each other; other columns are not read.  Pairs are never written: a block of candidates yields a count for each
    member and a spanning forest, and the members of a large bucket are dealt out to blocks of bounded numbers of shingles and members.
    """
    rows = stage(_signed_rows(id_and_text(docs, id_col, text_col), prefix_length(threshold, recall), shingle), "signatures")
    texts = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"),
                                       F.max("n").alias("n"), F.first("keys").alias("keys"))
    texts = stage(texts, "texts")
    seats = texts.select("digest", "n", F.posexplode("keys").alias("tree", "key"))
    # Buckets of several texts; of buckets with the same members the first tree's is kept.
    buckets = (seats.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("size"),
                                                F.bit_xor(F.xxhash64("digest")).alias("x"),
                                                F.bit_xor(F.xxhash64(F.reverse("digest"))).alias("y")).where("members > 1"))
    buckets = buckets.groupBy("x", "y", "members", "size").agg(F.min(F.struct("tree", "key")).alias("b"))
    buckets = buckets.select("b.*", _parts(block, members).alias("parts"))
    part = F.pmod(F.xxhash64("digest", F.lit("part")), F.col("parts")).cast("int").alias("part")
    seats = seats.join(buckets, ["tree", "key"]).select("digest", "tree", "key", "parts", part)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    seats = seats.select("digest", "tree", "key", "part", other).select(
        "digest", "tree", "key", "part", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"))
    seats = stage(seats, "seats")
    wanted = seats.select("digest").distinct().join(texts.select("digest", "first", "copies", "keys"), "digest")
    source = id_and_text(docs, id_col, text_col)
    source = source.select(F.md5(F.col("text").cast("binary")).alias("digest"), F.col("doc_id").alias("first"), "text")
    # One row of each wanted text; rows that repeat the first one are equal in both columns.
    some = source.join(wanted, (source["digest"] == wanted["digest"]) & source["first"].eqNullSafe(wanted["first"])).select(
        wanted["digest"], "copies", "keys", "text").dropDuplicates(["digest"])
    sets = "digest string, copies bigint, keys array<bigint>, grams binary"
    schema = arrow_schema(sets)

    def gram_rows(batches):
        for batch in batches:
            text = batch.column(3)
            grams = [shingles(text[i].as_py(), shingle).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(grams, pa.binary())], schema=schema)
    found = "digest string, links bigint, root string"
    found_schema = arrow_schema(found)
    blocks = some.mapInArrow(gram_rows, sets).join(seats, "digest").select(
        "tree", "key", "one", "two", "digest", "copies", "part", "keys", "grams")
    blocks = blocks.repartition("tree", "key", "one", "two").sortWithinPartitions("tree", "key", "one", "two", "digest")
    links = stage(blocks.mapInArrow(lambda b: _verify(b, found_schema, threshold), found), "found")
    counts = links.groupBy("digest").agg(F.sum("links").alias("links"))
    edges = links.where("digest != root").select(F.col("digest").alias("a"), F.col("root").alias("b"))
    roots = _classes(edges)
    texts = texts.join(counts, "digest", "left").join(roots, "digest", "left").select(
        "digest", "copies", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "digest").alias("root"))
    named = texts.join(texts.groupBy("root").agg(F.min("first").alias("class_id")), "root").select(
        "digest", "class_id", (F.col("links") + F.col("copies") - 1).alias("links"), "root")
    return rows.select("doc_id", "digest").join(named, "digest")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every class with all its columns: that with the least id, then the least digest of the text.

    Of rows with equal id and text one stays.  A class without ids keeps a row with a null id.
    """
    found = groups(docs, threshold, id_col=id_col, text_col=text_col)
    least = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("least"))
    chosen = least.select(F.col("least.doc_id").alias("chosen_id"), F.col("least.digest").alias("chosen_digest"))
    digest = F.md5(F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary"))
    # The table's own columns travel as one struct, so that no name of theirs meets one of this function.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("own_id"), digest.alias("own_digest"))
    kept = rows.join(chosen, rows["own_id"].cast("bigint").eqNullSafe(chosen["chosen_id"]) & (rows["own_digest"] == chosen["chosen_digest"]))
    return kept.dropDuplicates(["own_id", "own_digest"]).select("row.*")
