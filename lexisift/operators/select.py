"""Extraction from rank lists: redundancy-aware greedy choice, MMR, graph centrality and its penalty, sample clusters.

Each takes retrieved ranks, so a cluster's rows are bounded by the retrieval's k; a cluster is one call.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SELECTED = "cid string, pos long, doc_id long, sent_idx long"


def _cosine(a: Counter, b: Counter) -> float:
    dot = sum(v * b[k] for k, v in a.items() if k in b)
    size = (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
    return dot / size if size else 0.0


def _grams(words: list[str], n: int) -> set:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def greedy_rows(rows: list[dict], budget: int, unit: str, threshold: float, block: int | None = None, skips: int | str | None = None) -> list[dict]:
    """Walks the ranks and takes what isn't redundant until the budget is reached, the sentence that reaches it included.

    Redundant: an n-gram of ``block`` words shared with a taken sentence, or a cosine of ``threshold`` or more; a threshold of exactly 1
    disables both. With ``skips``, at most so many redundant sentences are passed over, then the rest is taken as it comes;
    "spare" allows as many as the list is longer than a budget of sentences, so that the budget is filled.
    """
    if skips == "spare":
        if unit != "sentences":
            raise ValueError(f"spare sentences of a budget of {unit}")
        skips = max(0, sum(len(r["words"]) > 0 for r in rows) - budget)
    taken, bags, grams, used, passed = [], [], set(), 0, 0
    for row in rows:
        words = list(row["words"])
        if not words:
            continue
        free = skips is not None and passed >= skips
        if taken and threshold != 1 and not free:
            own = _grams(words, block) if block else set()
            if own & grams or max(_cosine(Counter(words), b) for b in bags) >= threshold:
                passed += 1
                continue
        taken.append(row)
        bags.append(Counter(words))
        grams |= _grams(words, block) if block else set()
        used += len(words) if unit == "words" else 1
        if used >= budget:
            break
    return taken


def greedy(ranks: DataFrame, budget: int, unit: str = "words", threshold: float = 0.6, block: int | None = None, skips: int | str | None = None, texts: bool = False) -> DataFrame:
    """``(cid, pos, doc_id, sent_idx)``, with ``words`` if ``texts``, chosen from ``ranks(cid, rank, doc_id, sent_idx, words)``."""
    names = ["cid", "pos", "doc_id", "sent_idx"] + ["words"] * texts

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = greedy_rows(pdf.sort_values("rank").to_dict("records"), budget, unit, threshold, block, skips)
        return pd.DataFrame([tuple({**r, "pos": i + 1}[k] for k in names) for i, r in enumerate(rows)], columns=names)

    return ranks.select("cid", "rank", "doc_id", "sent_idx", "words").groupBy("cid").applyInPandas(one, SELECTED + ", words array<string>" * texts)


def _similarity(bags: list[Counter]) -> np.ndarray:
    known = {w: i for i, w in enumerate(sorted({w for b in bags for w in b}))}
    m = np.zeros((len(bags), max(1, len(known))))
    for i, b in enumerate(bags):
        for w, c in b.items():
            m[i, known[w]] = c
    size = np.linalg.norm(m, axis=1, keepdims=True)
    m = np.divide(m, size, out=np.zeros_like(m), where=size > 0)
    return m @ m.T


def lexrank_scores(sim: np.ndarray, restart: np.ndarray, damping: float = 0.85) -> np.ndarray:
    """The fixed point of ``p <- d M' p + (1 - d) r`` on the row-stochastic similarity without its diagonal; rows of zeros restart."""
    n = len(restart)
    m = sim - np.diag(np.diag(sim))
    total = m.sum(axis=1, keepdims=True)
    r = restart / restart.sum() if restart.sum() > 0 else np.full(n, 1 / max(1, n))
    m = np.divide(m, total, out=np.tile(r, (n, 1)), where=total > 0)
    return np.linalg.solve(np.eye(n) - damping * m.T, (1 - damping) * r)


def wan_order(score: np.ndarray, sim: np.ndarray, omega: float = 10) -> list[tuple[int, float]]:
    """Best first; every pick lowers the others by ``omega`` times their share of similarity to it times its first score."""
    if omega < 0:
        raise ValueError(f"omega {omega}")
    total = np.abs(sim).sum(axis=1, keepdims=True)
    m = np.divide(sim, total, out=np.zeros_like(sim), where=total > 0)
    now, left, out = score.astype(float).copy(), list(range(len(score))), []
    while left:
        i = max(left, key=lambda j: (now[j], -j))
        out.append((i, float(now[i])))
        left.remove(i)
        now[left] -= omega * m[left, i] * score[i]
    return out


def mmr_order(score: np.ndarray, sim: np.ndarray, weight: float = 0.7) -> list[tuple[int, float]]:
    """The best first, then the best of ``weight * score - (1 - weight) * greatest similarity to a pick``."""
    if weight < 0:
        raise ValueError(f"weight {weight}")
    left, out, near = list(range(len(score))), [], np.zeros(len(score))
    while left:
        value = {j: float(score[j]) if not out else weight * float(score[j]) - (1 - weight) * near[j] for j in left}
        i = max(left, key=lambda j: (value[j], -j))
        out.append((i, value[i]))
        left.remove(i)
        near = np.maximum(near, sim[:, i])
    return out


def reranked(ranks: DataFrame, kind: str, **options) -> DataFrame:
    """``(cid, pos, doc_id, sent_idx, score)``: ``ranks(cid, rank, doc_id, sent_idx, words, score)`` by lexrank, wan or mmr, scores rounded."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        sim, score = _similarity([Counter(w) for w in pdf["words"]]), pdf["score"].to_numpy(float)
        if kind == "lexrank":
            p = np.round(lexrank_scores(sim, score, **options), 9)
            order = [(int(i), float(p[i])) for i in np.argsort(-p, kind="stable")]
        else:
            order = {"wan": wan_order, "mmr": mmr_order}[kind](score / max(1e-12, score.sum()), sim - np.eye(len(sim)), **options)
        picked = pdf.iloc[[i for i, _ in order]]
        return pd.DataFrame({"cid": picked["cid"].to_numpy(), "pos": np.arange(1, len(order) + 1), "doc_id": picked["doc_id"].to_numpy(), "sent_idx": picked["sent_idx"].to_numpy(), "score": [round(s, 6) for _, s in order]})

    return ranks.select("cid", "rank", "doc_id", "sent_idx", "words", "score").groupBy("cid").applyInPandas(one, SELECTED + ", score double")


def sample_clusters(candidates: DataFrame, threshold: float = 0.6, target: int = 250, breaks: int = 5) -> DataFrame:
    """``(cluster_id, pos, sample_id)`` from ``candidates(cluster_id, rank, sample_id, words)``, the main sample at rank 0.

    A candidate too similar to a member is passed over; one is added if the words come no further from the target; at the fifth that isn't
    added, the cluster is closed.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("rank").to_dict("records")
        taken, bags, size, missed = [rows[0]], [Counter(rows[0]["words"])], len(rows[0]["words"]), 0
        for row in rows[1:]:
            bag, n = Counter(row["words"]), len(row["words"])
            if max(_cosine(bag, b) for b in bags) >= threshold:
                continue
            if abs(size + n - target) <= abs(size - target):
                taken.append(row)
                bags.append(bag)
                size += n
            else:
                missed += 1
                if missed >= breaks:
                    break
        return pd.DataFrame([(r["cluster_id"], i, r["sample_id"]) for i, r in enumerate(taken)], columns=["cluster_id", "pos", "sample_id"])

    return candidates.groupBy("cluster_id").applyInPandas(one, "cluster_id long, pos long, sample_id long")
