"""Quality by compression: zstandard dictionaries of good and of bad text, and the normalised difference of compressed sizes, calibrated."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisift.llm.shared import column_bytes, mapped
from lexisift.llm.toxicity import MAX_BYTES, MAX_ROWS, held_out, training_rows

#: Bytes of a dictionary (the size that separates best is kept), of a piece that is compressed by itself, and the level.
DICTIONARIES, PIECE, LEVEL = (8_000, 16_000, 32_000, 64_000, 100_000), 256, 1


def pieces(text: bytes) -> list[bytes]:
    """The whole text in pieces, so that the dictionary matters all along a long text as it does at its start."""
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)]


@dataclass
class Compressors:
    good: bytes
    bad: bytes
    slope: float = 1.0
    bias: float = 0.0

    def open(self) -> tuple:
        out = []
        for content in (self.good, self.bad):
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_AUTO)
            words.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=words, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
        return tuple(out)


def difference(text: bytes, good, bad) -> float:
    """Bytes that the bad dictionary needs beyond the good one, by the bytes that both need; 0 for no text."""
    g = b = 0
    for piece in pieces(text):
        g += len(good(piece))
        b += len(bad(piece))
    return (b - g) / (b + g) if b + g else 0.0


def _dictionary(texts: list[bytes], size: int) -> bytes:
    samples = [p for t in texts for p in pieces(t)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text to train on: the text itself
        return (b"".join(samples) or b" " * 8)[-size:].ljust(8)


def _separation(x: np.ndarray, y: np.ndarray) -> float:
    """Share of good and bad pairs in the right order."""
    rank = np.empty(len(x))
    rank[np.argsort(x, kind="stable")] = np.arange(len(x))
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / max(1, (y == 1).sum() * (y == 0).sum())


def fit(texts: list[bytes], labels: np.ndarray) -> Compressors:
    """Dictionaries of four fifths of the sample; their size and the calibration by a logistic curve from the rest."""
    labels = np.asarray(labels)
    fold = np.arange(len(texts)) % 5 == 0
    y = labels[fold].astype(float)
    prior = (labels.sum() + 0.5) / (len(labels) + 1)
    best = None
    for size in DICTIONARIES:
        out = Compressors(*(_dictionary([t for t, y, f in zip(texts, labels, fold, strict=True) if y == k and not f], size) for k in (1, 0)))
        if len(set(y.tolist())) < 2:
            out.slope, out.bias = 0.0, float(np.log(prior / (1 - prior)))
            return out
        good, bad = out.open()
        x = np.array([difference(t, good, bad) for t, f in zip(texts, fold, strict=True) if f])
        if best is None or _separation(x, y) > best[0]:
            best = (_separation(x, y), out, x)
    _, out, x = best
    scale = float(np.std(x)) or 1.0
    m = np.stack([x / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):  # Newton steps with a little ridge
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        w -= np.linalg.solve(m.T @ (m * (p * (1 - p) + 1e-9)[:, None]) + 1e-2 * np.eye(2), m.T @ (p - y) + 1e-2 * w * [1, 0])
    out.slope, out.bias = float(w[0] / scale), float(w[1])
    return out


def _scored(model):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = model.value
        good, bad = own.open()
        x = np.array([difference(t, good, bad) for t in column_bytes(batch, "text")])
        score = 1 / (1 + np.exp(-np.clip(own.slope * x + own.bias, -30, 30)))
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in ("doc_id", "held_out")), pa.array(score)], ["doc_id", "held_out", "score"])

    return run


def compression_quality(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, threshold: float = 0.3, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each ``docs(doc_id, text)`` row, learnt from ``labels(doc_id, quality)``.

    Dictionaries and calibration are fitted on the driver on ``max_rows`` labelled rows and ``max_bytes`` of text at most (``training_rows``),
    the dictionaries on all pieces of four fifths of them; two dictionaries of a fixed size are broadcast. Every whole text is compressed
    twice, in one pass without a shuffle. Empty and null texts have no difference and get the score of 0. Without labels of both classes the
    score is that of the prior. Repeated rows repeat their score, different texts under one id have their own; other columns are ignored. An
    empty table has no rows.
    """
    texts, ys = training_rows(docs, labels, "quality", modulus, held, max_rows, max_bytes)
    model = docs.sparkSession.sparkContext.broadcast(fit([t.encode() for t in texts], ys))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out(modulus, held))
    return mapped(rows, _scored(model), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
