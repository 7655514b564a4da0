"""Quality classifier: a weak-label model over heuristic labellers, whose posteriors train a hashed linear scorer."""
from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, id_and_text

SAMPLE = 16_000   # documents that the models are fitted on, on average
BUCKETS = 1 << 18
PREFIX = 4
FORM_TIMES = 4
FIT_ROWS = 1_000
SEEN = 5          # documents of the sample that must have a feature before it gets a weight
THRESHOLD, TOXIC = 0.5, 0.35
ABSTAIN = -1
# Prior accuracy, and its worth in votes: little beside the votes of a sample, so that these decide.
HEURISTIC, LEXICON, TABLE = (0.75, 4.0), (0.95, 20.0), (0.99, 50.0)
RESULT = "doc_id bigint, quality double, toxicity double, keep boolean"
_WORD = re.compile(r"[^\W\d_]+")

# English insults, in two lists that overlap as independent lexicons do.
INSULTS = frozenset("idiot moron stupid loser scum trash fool dumb jerk bastard".split())
SLIGHTS = frozenset("clown pathetic worthless disgusting loser trash scum idiot stupid garbage vermin filth".split())


@dataclass
class Form:
    """What the labellers look at in one text."""
    words: list[str]
    symbols: float
    capitals: float
    distinct: float
    repeats: float
    cells: float
    letters: dict[str, int]

    @classmethod
    def of(cls, text: str) -> Form:
        words = text.split()
        n = max(1, len(words))
        plain = _WORD.findall(text)
        count = sum(map(len, plain))
        upper = sum(len(w) for w in plain if len(w) > 1 and w.isupper())
        space = len(text) - sum(map(len, words))
        digits = sum(map(len, re.findall(r"\d+", text)))
        return cls(words, max(0, len(text) - space - count - digits) / max(1, len(text)), upper / max(1, count),
                   len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n, words.count("|") / n,
                   Counter(w.lower() for w in plain))


def _band(value: float, good: float, bad: float) -> int:
    """1 (good) up to ``good``, 0 (bad) from ``bad`` on, else no vote; for falling measures give negative numbers."""
    return 1 if value <= good else 0 if value >= bad else ABSTAIN


def form_votes(f: Form) -> list[int]:
    """Votes on the form of a text: 1 well formed, 0 ill formed."""
    n = len(f.words)
    return [_band(f.symbols, 0.06, 0.12), _band(f.capitals, 0.10, 0.30), _band(f.repeats, 0.05, 0.20),
            _band(f.cells, 0.02, 0.10), _band(-f.distinct, -0.70, -0.35) if n < 3000 else _band(-f.distinct, -0.5, -0.15),
            _band(max(f.letters.values(), default=n) / max(1, n), 0.12, 0.30) if n >= 20 else ABSTAIN]


def insult_votes(f: Form) -> list[int]:
    """Votes on insults: 1 toxic.  These labellers never vote 0."""
    a, b = sum(f.letters.get(w, 0) for w in INSULTS), sum(f.letters.get(w, 0) for w in SLIGHTS)
    rate = (a + b) / max(1, len(f.words))
    return [1 if a else ABSTAIN, 1 if b else ABSTAIN, 1 if rate > 0.005 else ABSTAIN]


def posterior(votes: np.ndarray, base: float, trust: list[tuple[float, float]], rounds: int = 60
              ) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over the votes (rows x labellers; -1: none).

    No vote says nothing.  ``base`` is the share of ones to start from, ``trust`` for each labeller its prior accuracy and
    the number of votes that is worth.  Returns the probability of 1 for each row, and each labeller's accuracy when the
    truth is 0 and when it is 1.
    """
    cast, ones = votes >= 0, votes == 1
    zeros = cast & ~ones
    p = (ones.sum(1) + base) / (cast.sum(1) + 1.0)
    for _ in range(rounds):
        prior = np.clip(p.mean(), 0.001, 0.999)
        odds = np.full(len(votes), np.log(prior / (1 - prior)))
        right = np.empty((votes.shape[1], 2))
        for j, (accuracy, worth) in enumerate(trust):
            right[j] = ((((1 - p) * zeros[:, j]).sum() + accuracy * worth) / (((1 - p) * cast[:, j]).sum() + worth),
                        ((p * ones[:, j]).sum() + accuracy * worth) / ((p * cast[:, j]).sum() + worth))
            odds += np.where(ones[:, j], np.log(right[j, 1] / (1 - right[j, 0])),
                             np.where(zeros[:, j], np.log((1 - right[j, 1]) / right[j, 0]), 0.0))
        now = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        done = np.abs(now - p).max() < 1e-6
        p = now
        if done:
            break
    return p, right


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) % BUCKETS


def form_features(f: Form) -> list[int]:
    """The measures in steps, and the votes on them; they count ``FORM_TIMES`` times as much as a word."""
    steps = (("symbols", f.symbols), ("capitals", f.capitals), ("distinct", f.distinct), ("repeats", f.repeats), ("cells", f.cells))
    out = [_bucket(f"{name}={min(9, int(value * 10))}") for name, value in steps]
    votes = form_votes(f)
    out += [_bucket(f"vote{j}={v}") for j, v in enumerate(votes)] + [_bucket(f"bad={votes.count(0)}")]
    return out * FORM_TIMES


def word_features(word: str) -> tuple[int, ...]:
    """A word and, for longer ones, its beginning."""
    return (_bucket("w=" + word), _bucket("p=" + word[:PREFIX])) if len(word) > PREFIX else (_bucket("w=" + word),)


def features(f: Form) -> np.ndarray:
    out = form_features(f)
    for w in f.letters:
        out.extend(word_features(w))
    return np.array(out, np.uint32)


def fit_linear(rows: list[np.ndarray], target: np.ndarray, weight: np.ndarray, rounds: int = 120, decay: float = 2e-3
               ) -> tuple[np.ndarray, float]:
    """Regularised logistic regression on hashed features; those of few documents keep weight 0.

    Both classes weigh the same in total.  Accelerated gradient steps over the whole sample, each weight with its own safe step (a bound of its curvature).
    """
    ones, all_ = (weight * target).sum(), weight.sum()
    weight = weight * np.where(target > 0.5, 0.5 * all_ / max(ones, 1.0), 0.5 * all_ / max(all_ - ones, 1.0))
    flat = np.concatenate(rows).astype(np.int64)
    usual = np.flatnonzero(np.bincount(flat, minlength=BUCKETS) >= SEEN)
    place = np.full(BUCKETS, len(usual) + 1)
    place[usual] = np.arange(len(usual))
    n, size = len(rows), len(usual) + 2
    # Every row ends with the constant feature, the last but one; the last one stands for unusual features.
    index = np.concatenate([np.append(place[r], len(usual)) for r in rows]).astype(np.int32)
    sizes = np.array([len(r) + 1 for r in rows])
    begin = np.concatenate(([0], np.cumsum(sizes)))
    blocks = [slice(a, min(a + FIT_ROWS, n)) for a in range(0, n, FIT_ROWS)]  # temporary arrays are as long as a block

    def over(values):
        """Sum over the rows that have a feature of the rows' values."""
        total = np.zeros(size)
        for k in blocks:
            part = np.repeat(values[k], sizes[k])
            total += np.bincount(index[begin[k.start]:begin[k.stop]], part, size)
        return total
    shrink = np.full(size, decay)
    shrink[-2] = 0
    step = 1 / (over(weight * sizes) / (4 * n) + shrink + 1e-9)
    step[-1] = 0
    w, ahead, t = np.zeros(size), np.zeros(size), 1.0
    for _ in range(rounds):
        z = np.concatenate([np.add.reduceat(ahead[index[begin[k.start]:begin[k.stop]]], begin[k] - begin[k.start]) for k in blocks])
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight
        now = ahead - step * (over(error) / n + shrink * ahead)
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = now + (t - 1) / nxt * (now - w)
        w, t = now, nxt
    out = np.zeros(BUCKETS, np.float32)
    out[usual] = w[:-2]
    return out, float(w[-2])


@dataclass
class Model:
    form: tuple[np.ndarray, float]
    insult: tuple[np.ndarray, float]
    form_accuracy: np.ndarray
    insult_accuracy: np.ndarray


def fit(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE, id_col: str = "doc_id",
        text_col: str = "text") -> Model | None:
    """Both models from about ``sample`` documents, chosen by a hash of the id and text.

    ``labels (doc_id, quality, toxic)``, where given, is one more labeller beside the heuristics: its votes count with
    the accuracy that they turn out to have.  Nulls in it are no votes.  Without documents there is no model.
    """
    rows = id_and_text(docs, id_col, text_col).where("text != ''")
    total = rows.count()
    if not total:
        return None
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 24)) / F.lit(float(1 << 24))
    rows = rows.where(draw < min(1.0, sample / total))
    if labels is None:
        known = rows.select("doc_id").limit(0).withColumns({"quality": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    else:
        known = labels.groupBy(labels["doc_id"].cast("bigint").alias("doc_id")).agg(
            F.max(F.when(labels["quality"].isin(0, 1), labels["quality"].cast("int"))).alias("quality"),
            F.max(F.when(labels["toxic"].isin(0, 1), labels["toxic"].cast("int"))).alias("toxic"))
    rows = rows.join(known, "doc_id", "left").select("doc_id", "text", F.coalesce("quality", F.lit(-1)).cast("bigint"),
                                                     F.coalesce("toxic", F.lit(-1)).cast("bigint"))
    ddl = "row bigint, form array<bigint>, insult array<bigint>, features binary"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            out = []
            doc_id, text, quality, toxic = batch.columns
            for i in range(batch.num_rows):
                f = Form.of(text[i].as_py())
                out.append((zlib.crc32(f"{doc_id[i].as_py()}".encode()), [*form_votes(f), quality[i].as_py()],
                            [*insult_votes(f), toxic[i].as_py()], features(f).tobytes()))
            yield batch_of(out, schema)
    got = rows.mapInArrow(run, ddl).toPandas().sort_values(["row", "features"], kind="stable")
    if not len(got):
        return None
    hashed = [np.frombuffer(b, np.uint32) for b in got["features"]]
    form, insult = np.stack(got["form"].to_numpy()), np.stack(got["insult"].to_numpy())
    good, form_accuracy = posterior(form, 0.8, [HEURISTIC] * (form.shape[1] - 1) + [TABLE])
    bad, insult_accuracy = posterior(insult, 0.1, [LEXICON] * (insult.shape[1] - 1) + [TABLE])
    told = (insult >= 0).any(axis=1)  # silence alone hardly teaches
    return Model(fit_linear(hashed, good, np.abs(2 * good - 1)),
                 fit_linear(hashed, bad, np.abs(2 * bad - 1) * np.where(told, 1.0, 0.02)), form_accuracy, insult_accuracy)


class Scorer:
    """Probabilities of single texts; the weights of words are remembered, in bounded number."""

    def __init__(self, model: Model, keep: int = 200_000):
        self.model, self.keep, self.known = model, keep, {}

    def _word(self, word: str) -> complex:
        form, insult = self.model.form[0], self.model.insult[0]
        return sum((complex(form[i], insult[i]) for i in word_features(word)), 0j)

    def __call__(self, text: str) -> tuple[float, float]:
        f = Form.of(text)
        new = [w for w in f.letters if w not in self.known]
        if len(self.known) + len(new) > self.keep:
            self.known, new = {}, list(f.letters)
        for w in new:
            self.known[w] = self._word(w)
        total, some = sum(map(self.known.__getitem__, f.letters), 0j), form_features(f)
        z = np.array([total.real + self.model.form[0][some].sum() + self.model.form[1],
                      total.imag + self.model.insult[0][some].sum() + self.model.insult[1]])
        good, bad = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return float(good), float(bad)


def _rated(text: str | None, scorer: Scorer | None, threshold: float, toxic: float) -> tuple[float, float, bool]:
    if not text or not text.strip() or scorer is None:
        return 0.0, 0.0, False
    good, bad = scorer(text)
    return good, bad, good >= threshold and bad < toxic


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, toxic: float = TOXIC, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``doc_id, quality, toxicity, keep`` of every row's whole text, in one narrow pass.

    A null or blank text has quality 0 and isn't kept; repeated rows each give a row; an empty table gives an empty one;
    other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two weight tables of BUCKETS floats
    schema = arrow_schema(RESULT)

    def run(batches):
        scorer = Scorer(shared.value) if shared.value else None
        for batch in batches:
            doc_id, text = batch.columns
            yield batch_of([(doc_id[i].as_py(), *_rated(text[i].as_py(), scorer, threshold, toxic))
                            for i in range(batch.num_rows)], schema)
    return id_and_text(docs, id_col, text_col).mapInArrow(run, RESULT)


def keep_good(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, toxic: float = TOXIC,
              text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model keeps, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value) if shared.value else None
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array([_rated(text[i].as_py(), scorer, threshold, toxic)[2]
                                         for i in range(batch.num_rows)], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
