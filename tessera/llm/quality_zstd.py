"""Quality classifier by compression: dictionaries from good and from bad text, and the difference of sizes.

A bounded sample of labelled rows is halved. All of one half's texts, cut in blocks, train one zstandard dictionary of
good and one of bad text. Every text is compressed whole, block by block, with either dictionary. Its difference is
(bad size - good size) / bytes: how many bytes of output per byte of text the good dictionary saves. The other half calibrates:
a logistic curve over the difference, which is the score's only input.

Blocks make the measure independent of length: a dictionary helps every block alike, not only a text's start. A text of any
length takes memory for itself and one block.
Nulls count as empty texts; an empty text has difference 0 and the score that the curve gives to it. Without labels of
both classes in both halves the score is the share of good labels with one added to each class. Equal texts have equal scores; a repeated row is
scored as often as it stands there, and an empty table has no scores. Columns other than id and text aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .sampling import held_out, labelled_sample
from .store import quoted, short_batches

#: The bound of the labelled sample.
SAMPLE_ROWS = 6000
#: Bytes of a block, in training and in scoring.
BLOCK, DICTIONARY_BYTES, LEVEL = 1024, 112 * 1024, 3


def dictionary(texts: list[str]) -> bytes:
    """A trained dictionary, or the blocks themselves where they are too few to train one."""
    blocks = [b[i : i + BLOCK] for t in texts if (b := t.encode("utf-8", "surrogatepass")) for i in range(0, len(b), BLOCK)]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, blocks)) // 4)), blocks).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(blocks)[-DICTIONARY_BYTES:] or b" " * 8


class Sizer:
    """Compressed sizes of a text with each dictionary."""

    def __init__(self, dictionaries: tuple[bytes, bytes]):
        self.by = []
        for raw in dictionaries:
            trained = raw[:4] == b"\x37\xa4\x30\xec"
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))

    def difference(self, text: str | None) -> float:
        """(size by the first dictionary - size by the second) / bytes."""
        raw = memoryview((text or "").encode("utf-8", "surrogatepass"))
        if not len(raw):
            return 0.0
        first, second = (sum(len(c.compress(raw[i : i + BLOCK])) for i in range(0, len(raw), BLOCK)) for c in self.by)
        return (first - second) / len(raw)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 100) -> tuple[float, float]:
    """(slope, shift) of the logistic curve over the differences, by damped Newton steps with a ridge."""
    mean, spread = float(x.mean()), float(x.std()) or 1.0
    a, w = np.stack([(x - mean) / spread, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(steps):
        p = logistic(a @ w)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (p - y) + ridge * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread)


class Model:
    """Dictionaries (bad, good) and the curve; without a curve a constant score."""

    def __init__(self, texts: list[str], labels: list[int]):
        y = np.array(labels, int)
        self.prior = float((y.sum() + 1) / (len(y) + 2))
        self.dictionaries, self.weights = (b"", b""), None
        half = np.arange(len(y)) % 2 == 0
        if all((y[part] == k).any() for part in (half, ~half) for k in (0, 1)):
            self.dictionaries = tuple(dictionary([t for t, own, k in zip(texts, half, y) if own and k == c]) for c in (0, 1))
            sizer = Sizer(self.dictionaries)
            rest = np.flatnonzero(~half)
            self.weights = calibrate(np.array([sizer.difference(texts[i]) for i in rest]), y[rest])

    def scores(self, texts: list[str | None], sizer: Sizer | None) -> tuple[np.ndarray, np.ndarray]:
        if sizer is None or not texts:
            return np.full(len(texts), self.prior), np.zeros(len(texts))
        x = np.array([sizer.difference(t) for t in texts])
        return logistic(self.weights[0] * x + self.weights[1]), x

    def sizer(self) -> Sizer | None:
        return Sizer(self.dictionaries) if self.weights is not None else None


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    return Model(*labelled_sample(docs, labels, label, sample_rows))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row of ``docs``: id, held_out, score, predicted, difference."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries and a few numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        sizer = m.sizer()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                score, diff = m.scores(part.column("text").to_pylist(), sizer)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(diff)], ["id", "held_out", "score", "predicted", "difference"])

    short_batches(docs.sparkSession)
    base = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text")).withColumn("held_out", held_out())
    return base.mapInArrow(run, f"id {dict(base.dtypes)['id']}, held_out boolean, score double, predicted int, difference double")
