"""Language-model scores: a log-bilinear model in three levels, trained by noise-contrastive estimation, and a unigram base.

Tokens live in blocks: one row holds the documents of a part of the corpus, its distinct words as hashes, and the stream of
local word numbers.  Counts, training and scoring are passes over blocks; only (block, word) rows and the places of rare words
are ever exchanged.
"""
from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, id_and_text, rows_at_once, rows_of, stage
from .fingerprints import word_hashes

BLOCK_TOKENS = 1 << 19
VOCABULARY = 1024   # words with a class of their own; the model's other words share classes, with a third level
MIN_COUNT = 5       # training tokens of a word in the model; rarer words share one class
DIM, TAIL_DIM = 32, 8
NOISE, TAIL_NOISE = 64, 8
WARM_BLOCKS = 256
LEARNERS = 2        # for each slot of the cluster
CHUNK = 1 << 16     # rows of words, or weights, that are averaged together
WARM_TOKENS = 300_000
BATCH = 2048
STEPS = 32          # batches of a block, within these bounds of tokens
LEAST_BATCH, MOST_BATCH = 256, 1 << 13
WORD_BATCH = 512    # tokens of a class in a step of the third level
WIDE = 1.5          # words of a class, as a multiple of the cube root of their number
OFTEN = 4096        # contexts from which on the two sides of a context are computed once for each word
END_HASH = np.uint64(0x9B1C3A5D7E2F4861)
FOLDS, HELD = 5, 1
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLOCKS = ("block bigint, doc_ids array<bigint>, sizes array<bigint>, vocab binary, train binary, stream binary")


def token_hashes(text: str) -> np.ndarray:
    """Hashes of the words between white space of ASCII, A-Z in lower case, and of the end."""
    return np.append(word_hashes(text.encode("utf-8", "replace").translate(_LOWER)), END_HASH)


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD


def pack_stream(numbers: np.ndarray) -> bytes:
    """Word numbers as a plane of low and a plane of high halves; the high one compresses to little."""
    return (numbers & 0xFFFF).astype("<u2").tobytes() + (numbers >> 16).astype("<u2").tobytes()


def unpack_stream(packed: bytes) -> np.ndarray:
    low, high = np.frombuffer(packed, "<u2").astype(np.uint32).reshape(2, -1)
    return low | high << np.uint32(16)


def token_blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole documents in blocks of about ``block_tokens`` tokens, with each word's count in training documents."""
    schema = arrow_schema(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, names, parts, held = TaskContext.get().partitionId(), 0, [], [], 0

        def block():
            sizes = np.array([len(p) for p in parts])
            vocab, stream = np.unique(np.concatenate(parts), return_inverse=True)
            learn = np.repeat([not is_held_out(n) for n in names], sizes)
            train = np.bincount(stream[learn], minlength=len(vocab)).astype("<u4")
            return batch_of([((part << 32) + seq, names, sizes.tolist(), vocab.astype("<u8").tobytes(), train.tobytes(),
                              pack_stream(stream))], schema)
        for batch in batches:
            doc_id, text = batch.columns
            for i in range(batch.num_rows):
                names.append(doc_id[i].as_py())
                parts.append(token_hashes(text[i].as_py()))
                held += len(parts[-1])
                if held >= block_tokens:
                    yield block()
                    seq, names, parts, held = seq + 1, [], [], 0
        if parts:
            yield block()
    return id_and_text(docs, id_col, text_col).mapInArrow(run, BLOCKS)


def _log_sums(z: np.ndarray) -> np.ndarray:
    """Log of the sum of exp of each row; ``z`` is kept."""
    top = z.max(axis=1)
    e = z - top[:, None]
    return np.log(np.exp(e, out=e).sum(axis=1)) + top


def _noise_contrast(z: np.ndarray, shift: np.ndarray, draws: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Gradient of the noise-contrastive loss by the logits z + log(draws) - shift, of which ``own`` is each row's true one.

    ``draws`` is the expected number of noise draws of a column.  Overwrites ``z``.
    """
    np.subtract(shift, z, out=z)
    np.exp(z, out=z)  # infinite is right
    z += 1
    np.divide(draws, z, out=z)
    rows = np.arange(len(z))
    z[rows, own] = z[rows, own] * (1 + 1 / draws)[own] - 1
    return z


@dataclass
class Model:
    """Words w = 0 .. K - 1, K for every rarer word, K + 1 for the start.

    Frequent words are classes of their own, the others share classes, in order of their counts; about the square root of
    the number of classes are a group.  With q = e(before) C1 + e(before that) C2 the three levels are
    first(g | context) = q . T[g] + b[g] over the groups, second(c | context) = q . S[c] + a[c] over the classes of the group
    and third(w | context) = q O . u[w] + d[w] over the words of the class; e(w) = R[class of w] + v[w] I.
    A word's probability is the product of the normalised levels.
    """
    words: np.ndarray  # sorted hashes of the K words
    cls: np.ndarray    # class of each of the K + 2
    group: np.ndarray  # group of each class
    spans: np.ndarray  # ranges of classes of the groups
    place: np.ndarray  # row of the third level, sorted by class; the zero row at the end where there is none
    edges: np.ndarray  # ranges of rows of the classes of several words
    share: np.ndarray  # log probability of each row's word in its class, by counts
    noise: np.ndarray  # unigram probabilities of the classes
    r: np.ndarray
    c1: np.ndarray
    c2: np.ndarray
    t: np.ndarray
    b: np.ndarray
    s: np.ndarray
    a: np.ndarray
    i: np.ndarray
    o: np.ndarray
    v: np.ndarray
    u: np.ndarray
    d: np.ndarray

    NAMES = ("r", "c1", "c2", "t", "b", "s", "a", "i", "o")
    TAIL = ("v", "u", "d")

    @classmethod
    def start(cls, words: np.ndarray, counts: np.ndarray, other: float, seed: int = 11, head: int = VOCABULARY) -> Model:
        rng, k = np.random.default_rng(seed), len(words)
        ranks = np.argsort(-counts, kind="stable")
        heads, tail = ranks[:head], ranks[head:]
        wide = max(1, math.ceil(WIDE * len(tail) ** (1 / 3)))
        edges = np.append(np.arange(0, len(tail), wide), len(tail))
        n = len(heads) + len(edges)  # the edges are one more than the ranges; the last class is every other word
        of, place = np.full(k + 2, n - 1, np.int32), np.full(k + 2, len(tail), np.int32)
        of[heads], of[tail], of[k + 1] = np.arange(len(heads)), len(heads) + np.arange(len(tail)) // wide, n
        place[tail] = np.arange(len(tail))
        side = math.ceil(math.sqrt(n))
        group, spans = (np.arange(n) // side).astype(np.int32), np.append(np.arange(0, n, side), n)
        noise = np.bincount(of[:k + 1], np.append(counts, other) + 0.5, n)
        share = np.log((counts[tail] + 0.5) / noise[of[tail]]).astype(np.float32)
        noise = noise / noise.sum()
        mass = np.bincount(group, noise)
        r = rng.normal(0, 0.1, (n + 1, DIM)).astype(np.float32)
        across = rng.normal(0, TAIL_DIM ** -0.5, (2, TAIL_DIM, DIM)).astype(np.float32)
        return cls(words, of, group, spans, place, edges, share, noise, r, np.eye(DIM, dtype=np.float32),
                   0.5 * np.eye(DIM, dtype=np.float32), np.zeros((len(mass), DIM), np.float32), np.log(mass).astype(np.float32),
                   np.zeros((n, DIM), np.float32), np.log(noise / mass[group]).astype(np.float32),
                   across[0], across[1].T.copy(), np.zeros((len(tail) + 1, TAIL_DIM), np.float32),
                   np.zeros((len(tail), TAIL_DIM), np.float32), share.copy())

    def classes(self, vocab: np.ndarray) -> np.ndarray:
        """The word numbers of hashes."""
        at = np.minimum(np.searchsorted(self.words, vocab), max(0, len(self.words) - 1))
        return np.where(self.words[at] == vocab, at, len(self.words)) if len(self.words) else np.zeros(len(vocab), np.int64)

    def contexts(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words one and two places before; the start stands before every document."""
        first, start = np.cumsum(sizes) - sizes, len(self.words) + 1
        one, two = np.roll(ids, 1), np.roll(ids, 2)
        one[first] = start
        two[first] = start
        two[(first + 1)[sizes > 1]] = start
        return one, two

    def _embedded(self, words: np.ndarray) -> np.ndarray:
        return self.r[self.cls[words]] + self.v[self.place[words]] @ self.i

    def _context(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self._embedded(one) @ self.c1 + self._embedded(two) @ self.c2

    def _queries(self, one: np.ndarray, two: np.ndarray) -> Callable[[np.ndarray | slice], np.ndarray]:
        """The vectors of chosen ones of these contexts.  Each is a sum of a row by each word, so rows of many contexts are shared."""
        if len(one) <= OFTEN:
            return lambda at: self._context(one[at], two[at])
        met = np.zeros(len(self.words) + 2, bool)
        met[one] = met[two] = True
        number, words = np.cumsum(met, dtype=np.int32) - np.int32(1), np.flatnonzero(met)
        near, far = np.empty((2, len(words), DIM), np.float32)
        for a in range(0, len(words), BATCH):
            e = self._embedded(words[a:a + BATCH])
            near[a:a + BATCH], far[a:a + BATCH] = e @ self.c1, e @ self.c2
        one, two = number[one], number[two]
        return lambda at: near[one[at]] + far[two[at]]

    def _log_totals(self, one: np.ndarray, two: np.ndarray, query: Callable | None = None) -> np.ndarray:
        """Log of the sum of exp over all groups for each pair of context words."""
        out, query = np.empty(len(one)), query or self._queries(one, two)
        for a in range(0, len(one), BATCH):
            out[a:a + BATCH] = _log_sums(query(slice(a, a + BATCH)) @ self.t.T + self.b)
        return out

    def log_probabilities(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of every token: of its group, its class in the group, and its word in the class.

        Tokens are sorted by class, so that a level is normalised for many tokens at once.
        """
        one, two = self.contexts(ids, sizes)
        query, c, rows, last = self._queries(one, two), self.cls[ids], self.place[ids], len(self.share)
        out, order = -self._log_totals(one, two, query), np.argsort(c, kind="stable")
        cuts = np.searchsorted(self.group[c[order]], np.arange(len(self.spans)))
        for g, (lo, hi) in enumerate(zip(self.spans, self.spans[1:])):
            for a in range(cuts[g], cuts[g + 1], BATCH):
                at = order[a:min(a + BATCH, cuts[g + 1])]
                q = query(at)
                z = q @ self.s[lo:hi].T + self.a[lo:hi]
                out[at] += q @ self.t[g] + self.b[g] + z[np.arange(len(at)), c[at] - lo] - _log_sums(z)
                begins = np.flatnonzero(np.diff(c[at], prepend=-1))
                for x, y in zip(begins, np.append(begins[1:], len(at))):
                    if rows[at[x]] < last:  # a class of several words
                        k = int(np.searchsorted(self.edges, rows[at[x]], "right"))
                        some, (u, v) = at[x:y], self.edges[k - 1:k + 1]
                        z = q[x:y] @ self.o @ self.u[u:v].T + self.d[u:v]
                        out[some] += z[np.arange(y - x), rows[some] - u] - _log_sums(z)
        return out / np.log(10)

    @np.errstate(over="ignore")
    def train(self, ids: np.ndarray, sizes: np.ndarray, rate: float = 0.05, seed: int = 11) -> None:
        """One pass of noise-contrastive estimation with AdaGrad, on all levels.

        Noise is of the unigram distribution of the groups, of the classes of a group, or of the words of a class, and enters
        by its expectation.  The third level is trained first, class by class, so that a step has all words of a class and
        many tokens; its gradient by the context goes into the batches of the other levels.  Rows of words and classes
        have one AdaGrad sum each, of summed rather than mean gradients, because they are met rarely.
        """
        rng, size = np.random.default_rng(seed), min(max(len(ids) // STEPS, LEAST_BATCH), MOST_BATCH)
        order = rng.permutation(len(ids))
        of = self.group[self.cls[ids[order]]]
        order = order[np.lexsort((of, np.arange(len(ids)) // size))]  # a batch is sorted by group
        one, two = (w[order] for w in self.contexts(ids, sizes))
        ids = ids[order]
        y, row, last = self.cls[ids], self.place[ids], len(self.share)
        square = {n: np.full_like(getattr(self, n), 1e-2) for n in self.NAMES}
        row_square = {n: np.ones(len(getattr(self, n)), np.float32) for n in ("r", "s", "a", *self.TAIL)}
        mass = np.bincount(self.group, self.noise)
        group_draws = (NOISE * mass).astype(np.float32)
        class_draws = (NOISE * self.noise / mass[self.group]).astype(np.float32)
        word_draws = TAIL_NOISE * np.exp(self.share)
        log_groups, log_classes, log_words = map(np.log, (group_draws, class_draws, word_draws))

        def step(name, at, g):
            square[name][at] += g * g
            getattr(self, name)[at] -= rate * g / np.sqrt(square[name][at])

        def row_step(name, at, g):
            row_square[name][at] += np.einsum("nd,nd->n", g, g) / g.shape[1]
            g = g * (rate / np.sqrt(row_square[name][at]))[:, None]
            getattr(self, name)[at] -= g if g.shape[1] > 1 else g[:, 0]

        def by_row(index, values, rows):
            columns = np.ascontiguousarray(values.T)
            return np.stack([np.bincount(index, column, rows) for column in columns], axis=1).astype(np.float32)
        deep = np.flatnonzero(row < last)
        deep = deep[np.argsort(row[deep], kind="stable")]
        slot, pull = np.full(len(ids), -1, np.int32), np.empty((len(deep), TAIL_DIM), np.float32)
        slot[deep] = np.arange(len(deep))
        for a in range(0, len(deep), size):
            some = deep[a:a + size]
            pull[a:a + size] = self._context(one[some], two[some]) @ self.o
        cuts = np.searchsorted(row[deep], self.edges)
        for lo, hi, begin, end in zip(self.edges, self.edges[1:], cuts, cuts[1:]):
            parts = -(-(end - begin) // WORD_BATCH)
            for k in range(parts):  # a part has every so many of the class's tokens
                at = slice(begin + k, end, parts)
                p = pull[at]
                e = _noise_contrast(p @ self.u[lo:hi].T, log_words[lo:hi] - self.d[lo:hi], word_draws[lo:hi], row[deep[at]] - lo)
                pull[at] = e @ self.u[lo:hi]
                row_step("u", slice(lo, hi), e.T @ p)
                row_step("d", slice(lo, hi), e.sum(axis=0)[:, None])
        for a in range(0, len(ids), size):
            w1, w2, c = one[a:a + size], two[a:a + size], y[a:a + size]
            count, g = np.float32(len(c)), self.group[c]
            r1, r2 = self._embedded(w1), self._embedded(w2)
            q = r1 @ self.c1 + r2 @ self.c2
            e = _noise_contrast(q @ self.t.T, log_groups - self.b, group_draws, g)
            dq, dt, db = e @ self.t, e.T @ q, e.sum(axis=0)
            ds, da = np.zeros_like(self.s), np.zeros_like(self.a)
            cuts = np.searchsorted(g, np.arange(len(self.spans)))
            for lo, hi, begin, end in zip(self.spans, self.spans[1:], cuts, cuts[1:]):
                if begin < end:
                    near = q[begin:end]
                    e = _noise_contrast(near @ self.s[lo:hi].T, log_classes[lo:hi] - self.a[lo:hi], class_draws[lo:hi], c[begin:end] - lo)
                    dq[begin:end] += e @ self.s[lo:hi]
                    ds[lo:hi], da[lo:hi] = e.T @ near, e.sum(axis=0)
            at = np.flatnonzero(slot[a:a + size] >= 0)
            dp = pull[slot[a:a + size][at]]
            dq[at] += dp @ self.o.T
            do = q[at].T @ dp
            both = np.concatenate([dq @ self.c1.T, dq @ self.c2.T])
            met, at = np.concatenate([self.cls[w1], self.cls[w2]]), np.concatenate([self.place[w1], self.place[w2]])
            known = np.flatnonzero(at < last)
            for name, g in (("c1", r1.T @ dq), ("c2", r2.T @ dq), ("t", dt), ("b", db), ("o", do)):
                step(name, ..., g / count)
            for name, g in (("s", ds), ("a", da[:, None]), ("r", by_row(met, both, len(self.r)))):
                row_step(name, slice(None), g)
            if len(known):
                some = both[known]
                di = self.v[at[known]].T @ some
                rows, index = np.unique(at[known], return_inverse=True)
                row_step("v", rows, by_row(index, some @ self.i.T, len(rows)))
                step("i", ..., di / count)

    def flat(self) -> np.ndarray:
        """All weights but the rows of words."""
        return np.concatenate([getattr(self, n).reshape(-1) for n in self.NAMES])

    def from_flat(self, values: np.ndarray) -> Model:
        """A model with these weights, and its own copy of the rows of words."""
        parts, at = {n: getattr(self, n).copy() for n in self.TAIL}, 0
        for n in self.NAMES:
            old = getattr(self, n)
            parts[n] = values[at:at + old.size].reshape(old.shape).astype(np.float32)
            at += old.size
        return replace(self, **parts)

    def tail(self, a: int, b: int) -> np.ndarray:
        """Rows of words side by side."""
        return np.concatenate([self.v[a:b], self.u[a:b], self.d[a:b, None]], axis=1)

    def move_tail(self, a: int, by: np.ndarray) -> None:
        b = a + len(by)
        self.v[a:b] += by[:, :TAIL_DIM]
        self.u[a:b] += by[:, TAIL_DIM:2 * TAIL_DIM]
        self.d[a:b] += by[:, -1]


def _training(row: dict, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Words and sizes of a block's training documents."""
    sizes = np.array(row["sizes"], np.int64)
    learn = np.array([not is_held_out(n) for n in row["doc_ids"]], bool)
    ids = model.classes(np.frombuffer(row["vocab"], "<u8"))[unpack_stream(row["stream"])]
    return ids[np.repeat(learn, sizes)], sizes[learn]


def vocabulary(counted: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """All training words of at least the minimum count with their exact counts, and the number of all training tokens."""
    got = counted.where("words IS NOT NULL").select("words", "n", "tokens").toPandas()  # as large as the vocabulary
    words = np.frombuffer(b"".join(got["words"]), "<u8")
    counts = np.frombuffer(b"".join(got["n"]), "<u4").astype(np.float64)
    order = np.argsort(words)
    return words[order], counts[order], int(got["tokens"].sum())


def fit(blocks: DataFrame, counted: DataFrame, size: int = VOCABULARY, warm_tokens: int = WARM_TOKENS
        ) -> tuple[Model, int, np.ndarray]:
    """The model, trained on every training token, the number of these tokens, and the counts of the model's words.

    A start on about ``warm_tokens`` tokens of a bounded number of blocks gives all tasks one orientation; then each of
    ``LEARNERS`` tasks a slot of the cluster makes a pass over the blocks it holds, so that the weights exchanged follow the
    cluster and the vocabulary rather than the number of blocks.  The mean of the tasks' weights, by tokens, is the model; a row of
    a word is the mean over the tasks that met it.
    """
    spark = blocks.sparkSession
    words, counts, total = vocabulary(counted)
    model = Model.start(words, counts, max(0.0, total - counts.sum()), head=size)
    if not total:
        return model, total, counts.astype(np.int64)
    start = spark.sparkContext.broadcast(model)
    all_blocks = blocks.select("block").count()
    some_blocks = blocks.where(F.pmod(F.xxhash64("block"), F.lit(math.ceil(all_blocks / WARM_BLOCKS))) == 0)
    quota = max(1, warm_tokens // max(1, some_blocks.select("block").count()))
    ddl = "block bigint, ids array<bigint>, sizes array<bigint>"
    schema = arrow_schema(ddl)

    def sample(batches):
        for batch in batches:
            for row in rows_of(batch):
                ids, sizes = _training(row, start.value)
                keep = np.cumsum(sizes) <= quota
                keep[:1] = True
                sizes = sizes[keep]
                yield batch_of([(row["block"], ids[:sizes.sum()].tolist(), sizes.tolist())], schema)
    with rows_at_once(spark, 1):  # one block at a time, however many a task has
        got = some_blocks.mapInArrow(sample, ddl).toPandas().sort_values("block")
    got = got[got["sizes"].map(len) > 0]
    if len(got):
        model.train(np.concatenate(got["ids"].to_list()).astype(np.int64), np.concatenate(got["sizes"].to_list()).astype(np.int64), rate=0.1)
    shared = spark.sparkContext.broadcast(model)
    part_ddl = "part bigint, tokens bigint, rows binary, weights binary"
    part_schema = arrow_schema(part_ddl)
    dense = model.flat().size

    def learn(batches):
        old = shared.value
        own, seen = old.from_flat(old.flat()), 0
        for batch in batches:
            for row in rows_of(batch):
                ids, sizes = _training(row, own)
                if len(ids):
                    own.train(ids, sizes, seed=int(row["block"] % (1 << 31)))
                    seen += len(ids)
        if seen:
            flat = own.flat()
            for k, a in enumerate(range(0, dense, CHUNK)):
                yield batch_of([(-1 - k, seen, b"", flat[a:a + CHUNK].astype("<f4").tobytes())], part_schema)
            for k, a in enumerate(range(0, len(old.share), CHUNK)):
                b = min(a + CHUNK, len(old.share))
                moved = own.tail(a, b) - old.tail(a, b)
                rows = np.flatnonzero(moved.any(axis=1))
                if len(rows):
                    yield batch_of([(k, seen, rows.astype("<u2").tobytes(), moved[rows].astype("<f2").tobytes())], part_schema)
    mean_schema = arrow_schema("part bigint, weights binary")
    width = 2 * TAIL_DIM + 1

    def means(batches):
        part, add, weight = None, None, None

        def done():
            return batch_of([(part, (add / np.maximum(weight, 1)).astype("<f4").tobytes())], mean_schema)
        for batch in batches:
            for row in rows_of(batch):
                if row["part"] != part:
                    if part is not None:
                        yield done()
                    part = row["part"]
                    size = len(row["weights"]) // 4 if part < 0 else CHUNK
                    add, weight = np.zeros((size, 1 if part < 0 else width)), np.zeros((size, 1))
                if part < 0:
                    at, values = slice(None), np.frombuffer(row["weights"], "<f4")[:, None]
                else:
                    at, values = np.frombuffer(row["rows"], "<u2"), np.frombuffer(row["weights"], "<f2").reshape(-1, width)
                add[at] += values.astype(np.float64) * row["tokens"]
                weight[at] += row["tokens"]
        if part is not None:
            yield done()
    learners = LEARNERS * spark.sparkContext.defaultParallelism
    parts = blocks.coalesce(learners).mapInArrow(learn, part_ddl).repartition("part").sortWithinPartitions("part")
    with rows_at_once(spark, 1):
        mean = dict(map(tuple, parts.mapInArrow(means, "part bigint, weights binary").collect()))  # as large as the model
    model = model.from_flat(np.concatenate([np.frombuffer(mean[-1 - k], "<f4") for k in range(-(-dense // CHUNK))]))
    for k, a in enumerate(range(0, len(model.share), CHUNK)):
        if k in mean:
            model.move_tail(a, np.frombuffer(mean[k], "<f4").reshape(-1, width)[:len(model.share) - a])
    return model, total, counts.astype(np.int64)


BUCKET_WORDS = 1 << 18
SLICES = 64         # slices of a block or bucket that Python gets at once


def _counts(blocks: DataFrame) -> DataFrame:
    """``block, bucket, c, new, words, n, tokens``: corpus counts of a block's words, in the order of its vocabulary.

    A count is one byte, ``MIN_COUNT`` for all from there on, which are counts of the model's words.

    Words are dealt out to buckets by ranges of their hash, as many as all blocks' vocabularies need.  A block sends each
    bucket a packed slice and gets its counts back; ``new`` adds up to the number of distinct training words and ``tokens``
    to that of training tokens; ``words, n`` are the bucket's words of the minimum count, once.  A word has
    at most one entry for each block, so no bucket grows with a word's frequency.
    """
    total = blocks.agg(F.sum(F.octet_length("vocab") / 8)).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET_WORDS))
    ddl = "bucket bigint, block bigint, vocab binary, train binary"
    schema = arrow_schema(ddl)

    def slices(batches):
        for batch in batches:
            for block, vocab, train in zip(*batch.columns, strict=True):
                words, n = np.frombuffer(vocab.as_py(), "<u8"), np.frombuffer(train.as_py(), "<u4")
                of = ((words >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)  # ascending, as the words are
                edges = np.flatnonzero(np.diff(of, prepend=of[:1] + 1, append=of[-1:] + 1))
                yield batch_of([(int(of[a]), block.as_py(), words[a:b].tobytes(), n[a:b].tobytes())
                                for a, b in zip(edges, edges[1:])], schema)
    back = "block bigint, bucket bigint, c binary, new bigint, words binary, n binary, tokens bigint"
    back_schema = arrow_schema(back)

    def add_up(bucket, held):
        words, place = np.unique(np.concatenate([w for _, w, _ in held]), return_inverse=True)
        c = np.bincount(place, np.concatenate([n for _, _, n in held]), len(words)).astype("<u4")
        at, out, often, few = 0, [], c >= MIN_COUNT, np.minimum(c, MIN_COUNT).astype("u1")
        for k, (block, own, _) in enumerate(held):
            once = (int((c > 0).sum()), words[often].tobytes(), c[often].tobytes(), int(c.sum(dtype=np.int64)))
            out.append((block, bucket, few[place[at:at + len(own)]].tobytes(), *(once if k == 0 else (0, None, None, 0))))
            at += len(own)
        return batch_of(out, back_schema)

    def sums(batches):
        bucket, held = None, []
        for batch in batches:
            for row in rows_of(batch):
                if row["bucket"] != bucket:
                    if held:
                        yield add_up(bucket, held)
                    bucket, held = row["bucket"], []
                held.append((row["block"], np.frombuffer(row["vocab"], "<u8"), np.frombuffer(row["train"], "<u4")))
        if held:
            yield add_up(bucket, held)
    dealt = blocks.select("block", "vocab", "train").mapInArrow(slices, ddl).repartition("bucket")
    return dealt.sortWithinPartitions("bucket", "block").mapInArrow(sums, back)


MODELLED = ("block bigint, bucket bigint, doc_ids array<bigint>, sizes array<bigint>, others array<bigint>, base binary, "
            "class binary, stream binary")
SCORES = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_log double, class_log double, "
          "other_log double, n_other bigint, new_words bigint")


def score(docs: DataFrame, size: int = VOCABULARY, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Both scores are log10 probabilities of the whole text with its end.  The base is the smoothed unigram over the exact
    counts of all training documents (crc32 of the id as text, mod 5, isn't 1).  The model gives each token the normalised
    probability of its word (of its class, and of the word in the class, both by context); a word of fewer than ``MIN_COUNT``
    training tokens has the probability of such a word by context times its own among these by smoothed counts.
    ``size`` words have classes of their own; the number of the model's words grows with the corpus.  A null or
    empty text is its end alone; a null id counts as an empty one (training); repeated rows each give a row and count;
    without training documents all counts are 0; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    blocks = stage(token_blocks(docs, block_tokens, id_col, text_col), "blocks")
    with rows_at_once(spark, SLICES):
        counted = stage(_counts(blocks), "counts")
    model, total, often = fit(blocks, counted, size)
    known = int(often.sum())
    shared = spark.sparkContext.broadcast((model, np.log10(np.append(often, 0) + 0.5)))
    part_schema, out_schema = arrow_schema(MODELLED), arrow_schema(SCORES)

    def by_model(batches):
        lm, logs = shared.value
        for batch in batches:
            for row in rows_of(batch):
                sizes, stream = np.array(row["sizes"], np.int64), unpack_stream(row["stream"])
                ids = lm.classes(np.frombuffer(row["vocab"], "<u8"))[stream]
                other, begin = ids == len(lm.words), np.cumsum(sizes) - sizes
                others, base, model_log = (np.add.reduceat(x, begin) for x in (
                    other.astype(np.int64), np.where(other, 0.0, logs[ids]), lm.log_probabilities(ids, sizes)))
                yield batch_of([(row["block"], -1, row["doc_ids"], row["sizes"], others.tolist(), base.astype("<f8").tobytes(),
                                 model_log.astype("<f8").tobytes(), pack_stream(stream[other]))], part_schema)
    modelled = stage(blocks.mapInArrow(by_model, MODELLED), "modelled", at_once=1)
    new = {"c": "binary", "new": "bigint"}
    rows = counted.select("block", "bucket", "c", "new").unionByName(
        modelled.withColumns({k: F.lit(None).cast(t) for k, t in new.items()}), allowMissingColumns=True)
    rows = rows.repartition("block").sortWithinPartitions("block", "bucket")

    def finish(row, counts, new):
        """Words that the model doesn't have count by what their buckets say."""
        sizes, others = np.array(row["sizes"], np.int64), np.array(row["others"], np.int64)
        c = np.concatenate(counts)[unpack_stream(row["stream"])]
        of, n = np.repeat(np.arange(len(sizes)), others), len(sizes)
        logs, base, model_log = (np.bincount(of, np.log10(c + 0.5), n), np.frombuffer(row["base"], "<f8"),
                                 np.frombuffer(row["class"], "<f8"))
        known = sizes - others + np.bincount(of[c > 0], minlength=n)
        fresh = [sum(new)] + [0] * (n - 1)
        return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(
            (row["doc_ids"], [is_held_out(d) for d in row["doc_ids"]], sizes, known, base + logs, model_log, logs, others, fresh),
            out_schema, strict=True)], schema=out_schema)

    def run(batches):
        row, counts, new = None, [], []
        for batch in batches:
            for one in rows_of(batch):
                if one["bucket"] < 0:  # a block begins
                    if row is not None:
                        yield finish(row, counts, new)
                    row, counts, new = one, [], []
                else:
                    counts.append(np.frombuffer(one["c"], "u1"))
                    new.append(one["new"])
        if row is not None:
            yield finish(row, counts, new)
    with rows_at_once(spark, SLICES):  # a block lies before its slices
        found = stage(rows.mapInArrow(run, SCORES), "scores")
    distinct = found.agg(F.sum("new_words")).first()[0] or 0
    base = float(np.log10(total + 0.5 * (distinct + 1)))
    other = float(np.log10(total - known + 0.5 * (distinct - len(model.words) + 1)))
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base_log") - F.col("n_tokens") * base).alias("base_score"),
        (F.col("class_log") + F.col("other_log") - F.col("n_other") * other).alias("score"))
