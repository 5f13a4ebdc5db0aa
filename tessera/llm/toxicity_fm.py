"""Toxicity by a factorization machine over hashed terms.

Terms of a text: its distinct words, lower-cased and stripped of what isn't a letter at either end, and their first 4, 5
and 6 letters (so that an inflected insult is known by its stem). Terms are hashed into 2**HASH_BITS buckets, and every
bucket has a weight and FACTORS factors; none is screened beforehand, since a term that says nothing alone may say much in a pair.
The machine scores w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j with x_i = 1 for terms that are present, so a pair such
as an insult and a mention of a group can weigh more than both do apart. It is trained on a bounded sample of labelled rows by normalised
gradient steps, both classes of equal weight. A step is shared among a text's terms by their evidence: a term's share grows with the square of its
standardised excess among toxic texts, up to that of EVIDENCE, and is FLOOR at least, so that no term is left out of any pair. What is sent to
the tasks is 2**HASH_BITS rows of FACTORS + 1 floats of 4 bytes, whatever the input. A last step fits a line in the margin (Platt's method, with
the sample's own shares of the classes, so that a score is a probability) over the whole sample: each text's margin comes from a machine that has learnt the other half. The machine
that scores has learnt all of it.

Every text is scored whole, in memory linear in its distinct words. Nulls count as empty texts; a text without terms has the score of
the bias. Without labels of both classes the score is the share of toxic labels with one added to each class. Equal texts have
equal scores; a repeated row is scored as often as it stands there, and so is each row of an empty table: none. Columns other
than id and text aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from xxhash import xxh64_intdigest

from .caches import hold
from .sampling import held_out, labelled_sample
from .store import quoted, short_batches

#: The bound of the labelled sample.
SAMPLE_ROWS = 12_000
HASH_BITS, FACTORS = 18, 8
RATE, START, FLOOR, EVIDENCE = 2.0, 0.1, 0.005, 12.0
#: Steps of training, as far as between the first and the last number of passes over the sample allow it.
STEPS, PASSES = 40_000, (8, 60)
#: Parts of the sample; the margins that fit the scores to probabilities come from machines that haven't seen the text's part.
FOLDS = 2
STEMS = (4, 5, 6)


def terms_of(word: str) -> list[int]:
    """The hashed terms of a word as it stands in a text."""
    a, b = 0, len(word)
    while a < b and not word[a].isalpha():
        a += 1
    while b > a and not word[b - 1].isalpha():
        b -= 1
    word = word[a:b].lower()
    if not word:
        return []
    names = ["w" + word] + [f"{n}{word[:n]}" for n in STEMS if len(word) >= n]
    return [xxh64_intdigest(n.encode("utf-8", "surrogatepass")) >> (64 - HASH_BITS) for n in names]


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Terms:
    """The sorted terms of whole texts, with a bounded cache of the terms of words."""

    def __init__(self, words: int = 300_000):
        self.words, self.cache = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.cache) > self.words:
            self.cache.clear()
        cache, terms = self.cache, set()
        for w in set((text or "").split()):
            got = cache.get(w)
            if got is None:
                got = cache[w] = tuple(terms_of(w))
            terms.update(got)
        out = np.fromiter(terms, np.int64, len(terms))
        out.sort()  # the sum of floats must not hang on the order of a set
        return out


class Model:
    def __init__(self, texts: list[str], labels: list[int], seed: int = 42):
        y = np.array(labels, int)
        self.prior = float((y.sum() + 1) / (len(y) + 2))
        self.slope, self.shift = 1.0, 0.0
        self.bias, self.weight, self.factor = 0.0, np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32)
        fold = np.zeros(len(y), int)  # every class is dealt in turn
        for k in (0, 1):
            fold[y == k] = np.arange((y == k).sum()) % FOLDS
        self.trained = all((y == k).sum() >= FOLDS for k in (0, 1))
        if self.trained:
            terms = Terms()
            rows = [terms(t) for t in texts]
            margins = np.zeros(len(y))
            for f in range(FOLDS):
                own, rest = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                self._fit([rows[i] for i in own], y[own], seed, STEPS // FOLDS)
                margins[rest] = [self.margin(rows[i]) for i in rest]
            self._fit(rows, y, seed, STEPS)
            self._calibrate(margins, y)

    @staticmethod
    def _evidence(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
        """The share that each bucket has in a step, between FLOOR and 1."""
        size, n, p = 1 << HASH_BITS, len(y), y.mean()
        every = np.bincount(np.concatenate(rows), minlength=size).astype(float)
        toxic = np.bincount(np.concatenate([r for r, k in zip(rows, y) if k]), minlength=size)
        excess = np.abs(toxic - every * p) / np.sqrt(np.maximum(every, 1) * p * (1 - p) * np.maximum(1 - every / n, 1e-3))
        return np.clip((excess / EVIDENCE) ** 2, FLOOR, 1)

    def _fit(self, rows: list[np.ndarray], y: np.ndarray, seed: int, steps: int) -> None:
        rng = np.random.default_rng(seed)
        share = self._evidence(rows, y)
        w, v, b = np.zeros(len(share)), rng.normal(0, START, (len(share), FACTORS)) * np.sqrt(share)[:, None], 0.0
        each = len(y) / (2 * np.bincount(y, minlength=2))
        passes = int(np.clip(steps / len(y), *PASSES))
        for k in range(passes):
            rate = RATE / (1 + 3 * k / passes)
            for i in rng.permutation(len(rows)):
                x = rows[i]
                vx = v[x]
                s = vx.sum(0)
                g = each[y[i]] * (logistic(b + w[x].sum() + 0.5 * float(s @ s - (vx * vx).sum())) - y[i])
                if abs(g) < 1e-3:
                    continue
                others, own = s - vx, share[x]
                step = rate * g / (1 + float(own.sum()) + float(own @ (others * others).sum(1)))
                b -= step
                w[x] -= step * own
                v[x] -= (step * own)[:, None] * others
        self.bias, self.weight, self.factor = float(b), w.astype(np.float32), v.astype(np.float32)

    def _calibrate(self, z: np.ndarray, y: np.ndarray) -> None:
        """The line in the margin that makes its logistic the likeliest, by damped Newton steps with a small ridge."""
        mean, spread = float(z.mean()), float(z.std()) or 1.0
        n = np.bincount(y, minlength=2)
        wanted = np.where(y == 1, (n[1] + 0.5) / (n[1] + 1), 0.5 / (n[0] + 1))
        a, c = np.stack([(z - mean) / spread, np.ones(len(z))], 1), np.array([1.0, 0.0])
        for _ in range(200):
            p = logistic(a @ c)
            move = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (p - wanted) + 1e-3 * c)
            c = c - np.clip(move, -1, 1)
            if np.abs(move).max() < 1e-9:
                break
        self.slope = max(float(c[0]) / spread, 1e-6)
        self.shift = float(c[1]) - self.slope * mean

    def margin(self, x: np.ndarray) -> float:
        vx = self.factor[x].astype(float)
        s = vx.sum(0)
        return self.bias + float(self.weight[x].sum(dtype=float)) + 0.5 * float(s @ s - (vx * vx).sum())

    def score(self, x: np.ndarray) -> float:
        return float(logistic(self.slope * self.margin(x) + self.shift)) if self.trained else self.prior


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS, seed: int = 42) -> Model:
    return Model(*labelled_sample(docs, labels, label, sample_rows), seed=seed)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Per row of ``docs``: id, held_out, score, predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**HASH_BITS x (FACTORS + 1) floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("toxicity")
        model, terms = held.value, Terms()
        for batch in batches:
            score = np.array([model.score(terms(t.as_py())) for t in batch.column("text")], float)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    short_batches(docs.sparkSession)
    base = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text")).withColumn("held_out", held_out())
    return base.mapInArrow(run, f"id {dict(base.dtypes)['id']}, held_out boolean, score double, predicted int")
