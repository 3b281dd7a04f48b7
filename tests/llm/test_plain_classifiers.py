"""The two classifiers against plain versions: n-grams as strings in dictionaries, and zstandard called piece by piece."""

import math
import zlib

import numpy as np
import pytest
import zstandard

from lexisift.llm import compression, queries, toxicity

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def world(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()}
    labels = spark.read.parquet(f"{DIR}/labels.parquet").collect()
    return texts, {r.doc_id: r.toxic for r in labels}, {r.doc_id: r.quality for r in labels}


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def training(texts, labels, modulus, held):
    """One row for each different text, with the label of the smallest id, by id."""
    seen, out = set(), []
    for i in sorted(labels):
        if i in texts and fold(i, modulus) != held and labels[i] is not None and texts[i] not in seen:
            seen.add(texts[i])
            out.append((texts[i], labels[i]))
    return out


def grams_of(text):
    c = f" {text.lower()} "
    return {c[i : i + n] for n in (4, 5, 6) for i in range(len(c) - n + 1)}


def test_toxicity(spark, world):
    texts, toxic, _ = world
    rows = training(texts, toxic, 4, 2)
    y = np.array([t for _, t in rows], float)
    n = [(y == 0).sum(), (y == 1).sum()]
    count = [{}, {}]
    for (text, t), own in zip(rows, map(grams_of, (t for t, _ in rows)), strict=True):
        for g in own:
            count[t][g] = count[t].get(g, 0) + 1
    scored = []
    for g, b in count[1].items() | {(g, 0) for g in count[0] if g not in count[1]}:
        a = count[0].get(g, 0)
        p = min((a + b + 1) / (n[0] + n[1] + 2), 0.999)
        z = abs(b / n[1] - a / n[0]) / math.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]))
        if a + b >= 3 and z > 3.5:
            scored.append((z, g, math.log((b + 0.5) / (n[1] + 1)) - math.log((a + 0.5) / (n[0] + 1))))
    assert len(scored) < 2048  # so the plain version needn't choose
    at = {g: k for k, (_, g, _) in enumerate(scored)}
    ratio = np.array([r for _, _, r in scored])

    def vector(text):
        x = np.zeros(len(at) + 1)
        x[-1] = 1
        for g in grams_of(text):
            if g in at:
                x[at[g]] = ratio[at[g]]
        return x

    x = np.stack([vector(t) for t, _ in rows])
    w, penalty = np.zeros(x.shape[1]), 1e-3 * np.append(np.ones(len(at)), 0)
    for _ in range(30):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) / len(x) + np.diag(penalty + 1e-12), x.T @ (p - y) / len(x) + penalty * w)
    got = {r.doc_id: r for r in queries.queries()["op4_toxicity"](spark, DIR).collect()}
    assert got.keys() == texts.keys()
    want = {i: 1 / (1 + math.exp(-float(np.clip(vector(t) @ w, -30, 30)))) for i, t in texts.items()}
    off = np.array([abs(got[i].score - want[i]) for i in texts])
    assert np.mean(off) < 0.01 and np.quantile(off, 0.99) < 0.1
    assert all(got[i].held_out == (fold(i, 4) == 2) and got[i].predicted == int(got[i].score >= 0.3) for i in texts)
    assert np.mean([got[i].predicted == (want[i] >= 0.3) for i in texts]) > 0.99


def test_quality(spark, world):
    texts, _, quality = world
    rows = training(texts, quality, 5, 0)
    model = compression.fit([t.encode() for t, _ in rows], np.array([q for _, q in rows]))
    got = {r.doc_id: r for r in queries.queries()["op5_quality_classifier"](spark, DIR).collect()}
    assert got.keys() == texts.keys()

    def size(text, content):
        out = 0
        for at in range(0, len(text), 256):
            words = zstandard.ZstdCompressionDict(content)
            out += len(zstandard.ZstdCompressor(level=1, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False).compress(text[at : at + 256]))
        return out

    for i in sorted(texts)[::9]:
        raw = texts[i].encode()[:20_000] if len(texts[i].encode()) <= 20_000 else None
        if raw is None:
            continue
        g, b = size(raw, model.good), size(raw, model.bad)
        x = (b - g) / (b + g) if b + g else 0.0
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-np.clip(model.slope * x + model.bias, -30, 30))), abs=1e-9)
    assert all(r.held_out == (fold(i, 5) == 0) and r.predicted == int(r.score >= 0.3) for i, r in got.items())


def test_features_are_those_of_plain_counts():
    rng = np.random.default_rng(2)
    words = ["alpha", "beta", "gamma", "delta", "rude", "nasty"]
    texts = [" ".join(rng.choice(words[:4], 6)) + (" " + rng.choice(words[4:]) if k % 3 == 0 else "") for k in range(120)]
    labels = np.array([int(k % 3 == 0) for k in range(120)])
    linear = toxicity.fit(texts, labels)
    kept = {int(h) for h in linear.kept}
    by_hash = {int(h): g for t in texts for g in grams_of(t) for h in _hash(g)}
    assert kept and all(h in by_hash for h in kept)
    assert {by_hash[h] for h in kept} >= {" nast", "nasty "}


def _hash(gram):
    """The hash of one n-gram, by the same rule as for a text that is this n-gram."""
    c = np.frombuffer(gram.encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = c[:1]
    for k in range(1, len(c)):
        h = h * toxicity._MUL + c[k : k + 1]
    return (h + np.uint64(len(c))) * toxicity._MIX
