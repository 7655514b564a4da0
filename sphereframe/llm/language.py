"""Language identification: a byte convolutional network trained in numpy, applied to fixed-length windows."""
from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of

LENGTH = 128           # bytes of a window
WIDTHS = (2, 3, 4, 5)  # of the filters
FILTERS = 16           # for each width
EMBED = 8
DOCUMENTS = 1_000      # labelled documents for each language, on average, that the network is trained on
WINDOWS = 6            # windows of each of them
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_CODE = "lang_pred string, score double"


def windows(text: str, length: int = LENGTH) -> np.ndarray:
    """The whole lower-cased text as rows of ``length`` UTF-8 bytes, the last one padded with zeros."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    rows = max(1, -(-len(data) // length))
    out = np.zeros((rows, length), np.uint8)
    out.reshape(-1)[:len(data)] = data
    return out


@dataclass
class Network:
    """Embedded bytes, filters of several widths as one matrix, max over positions, softmax."""
    names: list[str]
    embed: np.ndarray    # 256 x EMBED; byte 0 stays zero
    filters: np.ndarray  # (widest * EMBED) x (widths * FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def start(cls, names: list[str], seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        wide, n = max(WIDTHS), FILTERS * len(WIDTHS)
        return cls(names, rng.normal(0, 0.5, (256, EMBED)).astype(np.float32) * (np.arange(256) > 0)[:, None],
                   rng.normal(0, 0.3, (wide * EMBED, n)).astype(np.float32) * cls.shape(), np.zeros(n, np.float32),
                   rng.normal(0, 0.1, (n, len(names))).astype(np.float32), np.zeros(len(names), np.float32))

    @staticmethod
    def shape() -> np.ndarray:
        """Ones where a filter has weights: the first bytes of its width."""
        place = np.arange(max(WIDTHS) * EMBED)[:, None] // EMBED
        return (place < np.repeat(WIDTHS, FILTERS)[None, :]).astype(np.float32)

    def patches(self, rows: np.ndarray) -> np.ndarray:
        wide = max(WIDTHS)
        x = self.embed[np.pad(rows, ((0, 0), (0, wide - 1)))].reshape(len(rows), -1)
        return np.lib.stride_tricks.sliding_window_view(x, wide * EMBED, axis=1)[:, ::EMBED]

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.patches(rows)
        y = (p.reshape(-1, p.shape[-1]) @ self.filters).reshape(len(rows), rows.shape[1], -1)
        return p, y

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), len(self.names)), np.float32)
        for a in range(0, len(rows), 64):
            hidden = np.maximum(self.pooled(rows[a:a + 64])[1].max(axis=1) + self.bias, 0)
            out[a:a + 64] = _softmax(hidden @ self.out + self.out_bias)
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(rows: np.ndarray, labels: np.ndarray, names: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.004,
          seed: int = 7) -> Network:
    """Minimise cross entropy with Adam; the gradient reaches only the patch that each filter's maximum is at."""
    net, rng, step = Network.start(names, seed), np.random.default_rng(seed), 0
    params = ("embed", "filters", "bias", "out", "out_bias")
    first = {k: np.zeros_like(getattr(net, k)) for k in params}
    second = {k: np.zeros_like(getattr(net, k)) for k in params}
    wide, shape = max(WIDTHS), net.shape()
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), batch):
            x, y = rows[order[a:a + batch]], labels[order[a:a + batch]]
            p, score = net.pooled(x)
            at = score.argmax(axis=1)
            hidden = np.take_along_axis(score, at[:, None, :], 1)[:, 0] + net.bias
            active = np.maximum(hidden, 0)
            error = _softmax(active @ net.out + net.out_bias)
            error[np.arange(len(x)), y] -= 1
            error /= len(x)
            back = (error @ net.out.T) * (hidden > 0)
            best = p[np.arange(len(x))[:, None], at]                       # batch x filters x patch
            grads = {"out": active.T @ error, "out_bias": error.sum(0), "bias": back.sum(0),
                     "filters": np.einsum("bf,bfp->pf", back, best) * shape}
            into = (back[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
            codes = np.pad(x, ((0, 0), (0, wide - 1)))[np.arange(len(x))[:, None, None], at[:, :, None] + np.arange(wide)]
            grads["embed"] = np.stack([np.bincount(codes.reshape(-1), into[:, e], 256) for e in range(EMBED)], 1)
            grads["embed"][0] = 0
            step += 1
            for k in params:
                g = grads[k].astype(np.float32)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                change = first[k] / (1 - 0.9 ** step) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-6)
                setattr(net, k, getattr(net, k) - np.float32(rate) * change)
    return net


def training_windows(docs: DataFrame, learn: str | None, documents: int, id_col: str, text_col: str, lang_col: str
                     ) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of a bounded sample of labelled documents: a hash of the id decides, at one rate for each language."""
    rows = docs.select(docs[id_col].cast("string").alias("doc_id"), docs[text_col].cast("string").alias("text"),
                       docs[lang_col].cast("string").alias("lang")).where("lang is not null and text is not null")
    if learn:
        rows = rows.where(learn)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return np.zeros((0, LENGTH), np.uint8), np.zeros(0, np.int64), []
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, documents / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    ddl = "lang string, row bigint, data binary"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            out = []
            doc_id, text, lang = batch.columns
            for i in range(batch.num_rows):
                if not _LETTER.search(body := text[i].as_py()):
                    continue
                rows = windows(body)
                pick = np.unique(np.linspace(0, len(rows) - 1, WINDOWS).astype(int))
                for k in pick:
                    out.append((lang[i].as_py(), hash_row(doc_id[i].as_py(), k), rows[k].tobytes()))
            yield batch_of(out, schema)
    got = rows.where(draw < rate[F.col("lang")]).select("doc_id", "text", "lang").mapInArrow(run, ddl).toPandas()
    got = got.sort_values(["row", "data"], kind="stable")
    names = sorted(counts)
    data = np.frombuffer(b"".join(got["data"]), np.uint8).reshape(-1, LENGTH)
    labels = got["lang"].map({n: k for k, n in enumerate(names)}).to_numpy(np.int64)
    # Some windows are cut short, as short documents are.
    rng = np.random.default_rng(7)
    keep = np.where(rng.random(len(data)) < 0.3, rng.integers(8, LENGTH, len(data)), LENGTH)
    return data * (np.arange(LENGTH) < keep[:, None]), labels, names


def hash_row(doc_id: str | None, k: int) -> int:
    import zlib
    return zlib.crc32(f"{doc_id}:{k}".encode())


def fit(docs: DataFrame, learn: str | None = None, documents: int = DOCUMENTS, id_col: str = "doc_id",
        text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network trained on about ``documents`` documents of each language among those that ``learn`` (SQL) admits.

    Rows without a text, a letter or a label teach nothing; without any labelled row there is no network.
    """
    rows, labels, names = training_windows(docs, learn, documents, id_col, text_col, lang_col)
    return train(rows, labels, names) if len(rows) else None


def predict(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score``: the language with the highest mean probability over all windows of the whole text.

    A null text, one without a letter, or no network gives ``und`` with score 0.  Repeated rows each give a row; an empty
    table gives an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(network)  # some ten kilobytes
    ddl = f"doc_id bigint, {_CODE}"
    schema = arrow_schema(ddl)
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def run(batches):
        net = shared.value
        for batch in batches:
            doc_id, text = batch.columns
            names, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            todo, held = [], 0

            def flush():
                p = net.probabilities(np.concatenate([x for _, x in todo]))
                at = 0
                for i, x in todo:
                    mean = p[at:at + len(x)].mean(axis=0, dtype=np.float64)
                    at += len(x)
                    names[i], scores[i] = net.names[int(mean.argmax())], float(min(1.0, mean.max()))
            for i in range(batch.num_rows):
                body = text[i].as_py()
                if net is None or not body or not _LETTER.search(body):
                    continue
                todo.append((i, windows(body)))
                held += len(todo[-1][1])
                if held >= 2048:
                    flush()
                    todo, held = [], 0
            if todo:
                flush()
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=schema)
    return rows.mapInArrow(run, ddl)
