"""Toxicity: a linear classifier of character n-grams whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisift.llm.shared import column_text, mapped

#: n-gram lengths; bits of the slot that screens n-grams; features kept at most; standard errors that a slot and a feature need; texts that it needs.
SIZES, BITS, MAX_FEATURES, SCREEN, LEAST, TEXTS = (4, 5, 6), 22, 2048, 3.0, 3.5, 3
#: Labelled rows learnt from at most, and UTF-8 bytes of their texts at most.
MAX_ROWS, MAX_BYTES = 6000, 48_000_000

_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SLOT = np.uint64(64 - BITS)


def grams(text: str) -> Iterator[np.ndarray]:
    """64-bit hashes of the character n-grams of a lower-cased text with a space at either end, size by size."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    h = c
    for n in range(2, max(SIZES) + 1):
        if len(c) < n:
            return
        h = h[:-1] * _MUL + c[n - 1 :]
        if n in SIZES:
            yield (h + np.uint64(n)) * _MIX


def _chosen(text: str, slots: np.ndarray) -> np.ndarray:
    """Distinct n-grams whose slot is set."""
    found = [g[slots[g >> _SLOT]] for g in grams(text)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


@dataclass
class Linear:
    """Kept n-grams in order, their weights with the log-count ratios multiplied in, and the bias."""

    kept: np.ndarray
    weights: np.ndarray
    bias: float

    def slots(self) -> np.ndarray:
        out = np.zeros(1 << BITS, bool)
        out[self.kept >> _SLOT] = True
        return out

    def raw(self, text: str, slots: np.ndarray) -> float:
        own = _chosen(text, slots)
        if not len(own):
            return self.bias
        at = np.minimum(np.searchsorted(self.kept, own), len(self.kept) - 1)
        return self.bias + float(self.weights[at][self.kept[at] == own].sum())


def _significance(a: np.ndarray, b: np.ndarray, n: list[float]) -> np.ndarray:
    """How far the shares of clean and toxic texts with an n-gram are apart, in standard errors; 0 for n-grams of fewer than ``TEXTS`` texts."""
    pooled = np.clip((a + b + 1) / (n[0] + n[1] + 2), 0, 0.999)
    z = np.abs(b / n[1] - a / n[0]) / np.sqrt(pooled * (1 - pooled) * (1 / n[0] + 1 / n[1]))
    z[a + b < TEXTS] = 0
    return z


def fit(texts: list[str], labels: np.ndarray, ridge: float = 1e-3, rounds: int = 400, max_features: int = MAX_FEATURES) -> Linear:
    """Log-count ratios of present n-grams, the most significant of them as features, and a ridge logistic regression over present * ratio.

    Slots of n-grams are screened first (the ``4 * max_features`` best with ``SCREEN`` standard errors or more), then the n-grams of these slots
    are counted themselves: memory doesn't grow with the sample. Features are the ``max_features`` best n-grams of ``LEAST`` standard errors or
    more; with more than a quarter of the ``2**BITS`` slots, every slot is counted.
    """
    labels = np.asarray(labels, float)
    n = [max(1.0, float((labels == k).sum())) for k in (0, 1)]
    count = np.zeros((2, 1 << BITS), np.float32)
    for t, y in zip(texts, labels, strict=True):
        found = [g >> _SLOT for g in grams(t)]
        if found:
            count[int(y), np.unique(np.concatenate(found))] += 1
    z = _significance(count[0], count[1], n)
    wide = min(4 * max_features, len(z) - 1)
    best = np.argpartition(-z, wide)[:wide] if wide < len(z) - 1 else np.arange(len(z))
    slots = np.zeros(1 << BITS, bool)
    slots[best[z[best] > SCREEN]] = True
    del count, z
    seen = [_chosen(t, slots) for t in texts]
    known, at = np.unique(np.concatenate(seen), return_inverse=True) if seen else (np.zeros(0, np.uint64), np.zeros(0, int))
    toxic = np.repeat(labels, [len(s) for s in seen])
    b = np.bincount(at, weights=toxic, minlength=len(known))
    a = np.bincount(at, minlength=len(known)) - b
    z = _significance(a, b, n)
    keep = np.sort(np.argsort(-z, kind="stable")[:max_features])
    keep = keep[z[keep] > LEAST]
    kept = known[keep]
    ratio = (np.log((b[keep] + 0.5) / (n[1] + 1)) - np.log((a[keep] + 0.5) / (n[0] + 1))).astype(np.float32)
    x = np.zeros((len(texts), len(kept) + 1), np.float32)
    x[:, -1] = 1
    if len(kept):
        for i, s in enumerate(seen):
            j = np.minimum(np.searchsorted(kept, s), len(kept) - 1)
            j = j[kept[j] == s]
            x[i, j] = ratio[j]
    penalty = np.full(x.shape[1], ridge, np.float32)
    penalty[-1] = 0
    # accelerated gradient descent at the step that the largest curvature allows
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (0.25 * float(np.linalg.norm(x.T @ (x @ v))) / len(x) + ridge + 1e-9)
    w = look = np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ look, -30, 30)))
        after = look - step * (x.T @ (p - labels).astype(np.float32) / len(x) + penalty * look)
        look, w = after + (k / (k + 3)) * (after - w), after
    return Linear(kept, (w[:-1] * ratio).astype(np.float32), float(w[-1]))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, max_rows: int, max_bytes: int) -> tuple[list[str], np.ndarray]:
    """Texts and labels of a bounded sample outside of the held-out fold, by a hash of the id: ``max_rows`` rows and ``max_bytes`` of text at most.

    Of an id with several labels the least one counts, and of one with several texts the one with the least hash, so a labelled id is one row
    whatever the tables repeat. Equal texts count once, with the label of the smallest id. First only ids, hashes and lengths reach the driver
    (``max_rows`` at most), then the texts that fit; a text that doesn't fit any more is left out, and shorter ones after it are taken.
    """
    outside = f"pmod(crc32(cast(cast(doc_id as string) as binary)), {modulus}) <> {held}"
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null").where(outside)
    own = own.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = F.struct(F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("size"))
    found = rows.join(F.broadcast(own), "doc_id").groupBy("doc_id", "y").agg(F.min(size).alias("t")).select("doc_id", "y", "t.h", "t.size").collect()
    taken, seen, total = [], set(), 0
    for r in sorted(found):
        if (r["h"], r["size"]) not in seen:
            seen.add((r["h"], r["size"]))
            taken.append(r)
    chosen = []
    for r in sorted(taken, key=lambda r: (zlib.crc32(b"%d" % r["doc_id"]), r["doc_id"])):
        if total + r["size"] <= max_bytes:
            total += r["size"]
            chosen.append((r["doc_id"], r["h"], r["size"], r["y"]))
    if not chosen:
        return [], np.zeros(0, int)
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long, h long, size long, y int"))
    texts = rows.withColumn("h", F.xxhash64("text")).join(wanted, ["doc_id", "h"]).where(F.octet_length("text") == F.col("size")).dropDuplicates(["doc_id"]).select("doc_id", "text", "y")
    texts = sorted(texts.collect(), key=lambda r: r["doc_id"])
    return [r["text"] for r in texts], np.array([r["y"] for r in texts], int)


def held_out(modulus: int, held: int):
    """Whether a document is in the fold that no label is learnt from; a null id isn't."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == held, F.lit(False))


def _scored(model):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        linear = model.value
        slots = linear.slots()
        raw = np.array([linear.raw(text, slots) for text in column_text(batch, "text")])
        score = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in ("doc_id", "held_out")), pa.array(score)], ["doc_id", "held_out", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, threshold: float = 0.3, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, max_features: int = MAX_FEATURES) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each ``docs(doc_id, text)`` row, learnt from ``labels(doc_id, toxic)``.

    The model is fitted on the driver on ``max_rows`` labelled rows and ``max_bytes`` of text at most (``training_rows``) and broadcast:
    ``max_features`` n-grams and weights at most. Every whole text is scored in one pass without a shuffle. Only the text is an input of a
    score. Empty and null texts get the score of no n-grams. Without labels, or with one class only, the score is that of the prior. Repeated
    rows repeat their score, different texts under one id have their own; other columns are ignored. An empty table has no rows.
    """
    texts, ys = training_rows(docs, labels, "toxic", modulus, held, max_rows, max_bytes)
    if len(set(ys.tolist())) == 2:
        linear = fit(texts, ys, max_features=max_features)
    else:
        prior = (float(ys.sum()) + 0.5) / (len(ys) + 1)
        linear = Linear(np.zeros(0, np.uint64), np.zeros(0, np.float32), float(np.log(prior / (1 - prior))))
    model = docs.sparkSession.sparkContext.broadcast(linear)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out(modulus, held))
    return mapped(rows, _scored(model), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
