"""Periodic runs of words: Crochemore's partition refinement by length, whose neighbouring class members reveal squares, merged into runs."""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisift.llm.shared import column_bytes

#: Words of documents that are refined together (a document at least); positions to move under which a level is refined one by one.
PART_WORDS, FEW = 100_000, 200

RUNS = "array<struct<start: int, length: int, period: int>>"


class Partition:
    """Classes of positions at which equal factors of ``level`` words begin, refined a word at a time.

    Several documents lie behind one another, each followed by a position of its own class, so that no factor leaves its document.
    ``nxt`` and ``prv`` hold a position's neighbours in its class. A class splits by the small classes of the level before only: of the
    parts of a class the largest isn't looked at again, so a position moves a logarithmic number of times.
    """

    def __init__(self, classes: np.ndarray, limit: np.ndarray):
        n = len(classes)
        self.level, self.limit, self.cls = 1, limit, classes.copy()
        order = np.argsort(classes, kind="stable")
        same = classes[order[1:]] == classes[order[:-1]]
        self.nxt, self.prv = np.full(n, -1), np.full(n, -1)
        self.nxt[order[:-1][same]] = order[1:][same]
        self.prv[order[1:][same]] = order[:-1][same]
        self.size, self.head = np.zeros(n + 1, int), np.full(n + 1, -1)
        counts = np.bincount(classes)
        self.size[: len(counts)] = counts
        firsts = order[np.concatenate([[True], ~same])]
        self.head[classes[firsts]] = firsts
        self.used = len(counts)
        self.small = np.arange(n)

    def squares(self) -> np.ndarray:
        """Positions whose next class member is ``level`` words on: a square of that primitive period begins there."""
        return np.flatnonzero((self.nxt - np.arange(len(self.nxt)) == self.level) & (self.limit >= self.level))

    def refine(self) -> None:
        """From ``level`` to the next: positions before members of small classes move, ordered by class, class of the next word and place."""
        cls, nxt, prv, size, head = self.cls, self.nxt, self.prv, self.size, self.head
        self.level += 1
        a = self.small - 1
        a = a[a >= 0]
        a = a[(size[cls[a]] > 1) & (self.limit[a] >= self.level)]
        if not len(a):
            self.small = a
            return
        a = a[np.lexsort((a, cls[a + 1], cls[a]))]
        c, s = cls[a], cls[a + 1]
        group = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (s[1:] != s[:-1])]))
        sizes, of = np.diff(np.append(group, len(a))), c[group]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(of))))
        rest, best = size[of[first]] - np.add.reduceat(sizes, first), np.maximum.reduceat(sizes, first)
        largest = np.full(len(first), -1)
        candidates = np.flatnonzero(sizes == best[owner])[::-1]
        largest[owner[candidates]] = candidates

        # take the moved positions out of their classes; neighbours that go together are one chain
        b = a[np.lexsort((a, c))]
        chain = np.flatnonzero(prv[b] != np.concatenate([[-2], b[:-1]]))
        before, after, own = prv[b[chain]], nxt[b[np.append(chain[1:], len(b)) - 1]], cls[b[chain]]
        nxt[before[before >= 0]] = after[before >= 0]
        prv[after[after >= 0]] = before[after >= 0]
        head[own[before < 0]] = after[before < 0]

        # a class of which nothing is left goes on as its largest part
        ids = self.used + np.arange(len(group))
        whole = largest[rest == 0]
        ids[whole] = -1
        ids[ids >= 0] = self.used + np.arange(np.count_nonzero(ids >= 0))
        self.used += np.count_nonzero(ids >= 0)
        ids[whole] = of[whole]
        size[of[first]] = rest
        size[ids], head[ids] = sizes, a[group]
        cls[a] = np.repeat(ids, sizes)
        follows = np.concatenate([[False], np.repeat(np.arange(len(group)), sizes)[1:] == np.repeat(np.arange(len(group)), sizes)[:-1]])
        prv[a] = np.where(follows, np.concatenate([[-1], a[:-1]]), -1)
        nxt[a] = np.where(np.append(follows[1:], False), np.append(a[1:], -1), -1)

        left = (rest > 0) & (rest < best)
        spared = np.zeros(len(group), bool)
        spared[largest[(rest == 0) | left]] = True
        small, walk = [a[~np.repeat(spared, sizes)]], head[of[first][left]]
        while len(walk):
            small.append(walk)
            walk = nxt[walk]
            walk = walk[walk >= 0]
        self.small = np.concatenate(small)

    def finish(self) -> Iterator[tuple[int, list[int]]]:
        """The levels to come, a position at a time, for the few that still move: ``(level, positions of squares)``."""
        cls, nxt, prv, limit = self.cls.tolist(), self.nxt.tolist(), self.prv.tolist(), self.limit.tolist()
        size, head, small, level = self.size.tolist(), self.head.tolist(), self.small.tolist(), self.level
        due: dict[int, list[int]] = defaultdict(list)
        gap = self.nxt - np.arange(len(nxt))
        for i in np.flatnonzero((gap > level) & (gap <= self.limit)).tolist():
            due[nxt[i] - i].append(i)
        while small:
            level += 1
            moved: dict[int, dict[int, list[int]]] = {}
            for x in sorted(small):
                if x and size[cls[x - 1]] > 1 and limit[x - 1] >= level:
                    moved.setdefault(cls[x - 1], {}).setdefault(cls[x], []).append(x - 1)
            small = []
            for c, groups in moved.items():
                parts = sorted(groups.values(), key=len)
                rest = size[c] - sum(map(len, parts))
                if not rest and len(parts) == 1:
                    continue
                for part in parts:
                    for i in part:
                        p, q = prv[i], nxt[i]
                        if p >= 0:
                            nxt[p] = q
                            if q >= 0 and level <= q - p <= limit[p]:
                                due[q - p].append(p)
                        else:
                            head[c] = q
                        if q >= 0:
                            prv[q] = p
                size[c] = rest
                for k, part in enumerate(parts):
                    last = k == len(parts) - 1
                    if last and not rest:
                        own = c
                    else:
                        own = self.used
                        self.used += 1
                    size[own], head[own], p = len(part), part[0], -1
                    for i in part:
                        cls[i], prv[i], nxt[i] = own, p, -1
                        if p >= 0:
                            nxt[p] = i
                            if level <= i - p <= limit[p]:
                                due[i - p].append(p)
                        p = i
                    if not last or rest >= len(part):
                        small += part
                    elif rest:
                        i = head[c]
                        while i >= 0:
                            small.append(i)
                            i = nxt[i]
            if level in due and (found := sorted({i for i in due.pop(level) if nxt[i] - i == level})):
                yield level, found


def runs_of(texts: list[list[bytes]], power: int, least: int) -> list[list[tuple[int, int, int]]]:
    """Of each word list the runs ``(start, length, period)`` with ``length >= max(least, power * period)``, by start and period."""
    classes, limits, begin, at, used = [], [], [], 0, 0
    for words in texts:
        ids = dict(zip(dict.fromkeys(words), itertools.count(used)))
        used += len(ids) + 1
        classes.append(np.fromiter(itertools.chain(map(ids.__getitem__, words), [used - 1]), int, len(words) + 1))
        limits.append(len(words) // power)
        begin.append(at)
        at += len(words) + 1
    if not texts:
        return []
    begin = np.array(begin)
    parts = Partition(np.concatenate(classes), np.repeat(limits, [len(c) for c in classes]))
    found = [(1, parts.squares())]
    while len(parts.small) > FEW and parts.level < max(limits):
        parts.refine()
        found.append((parts.level, parts.squares()))
    if parts.level < max(limits):
        found += parts.finish()
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for period, starts in found:
        starts = np.asarray(starts)
        if not len(starts):
            continue
        cut = np.flatnonzero(np.diff(starts) > 1)
        low, high = starts[np.concatenate([[0], cut + 1])], starts[np.append(cut, len(starts) - 1)]
        length = high - low + 2 * period
        fits = length >= max(least, power * period)
        doc = np.searchsorted(begin, low[fits], side="right") - 1
        for d, s, n in zip(doc.tolist(), (low[fits] - begin[doc]).tolist(), length[fits].tolist(), strict=True):
            out[d].append((s, n, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run contains after its first period."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, int)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join(itertools.compress(words, (gone.cumsum() == 0).tolist()))


def _found(power: int, least: int):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("period", pa.int32())]))

    def part(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of(texts, power, least)
        rows = [[{"start": s, "length": n, "period": p} for s, n, p in runs] for runs in found]
        kept = pa.array([collapsed(w, r) for w, r in zip(texts, found, strict=True)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(w) for w in texts], pa.int64()), pa.array(rows, kind), kept], ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches):
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), column_bytes(batch, "text"), strict=True):
                words = text.split()  # of bytes: exactly \x20 and \x09-\x0D
                ids.append(doc_id)
                texts.append(words)
                size += len(words)
                if size >= PART_WORDS:
                    yield part(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield part(ids, texts)

    return run


def periodic_runs(docs: DataFrame, power: int = 4, least: int = 6) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` for each row of ``docs(doc_id, text)``: maximal runs of a text's words and the text without their repeats.

    A run ``(start, length, period)`` is a stretch that repeats itself after its smallest period, ``length >= max(least, power * period)``,
    and that no neighbouring word extends. 1. Positions fall into classes by the word there. 2. Classes of equal factors of ``l`` words are
    refined to ``l + 1`` words by the small classes of ``l`` only (the smaller halves). 3. Two neighbouring members of a class at distance
    ``l`` are a square of primitive period ``l``; neighbouring squares of a period are one run. Periods beyond ``n_words / power`` can't
    fulfil ``power``, so a document's refinement ends there.

    Documents don't meet, so there is no shuffle. A task refines some ``PART_WORDS`` words at a time, or one document: a text of n words
    takes some 400 bytes a word, and time in n log n whatever is in it. Null and empty texts have no words, no runs and an empty
    ``collapsed``; repeated rows repeat theirs; null ids stay; other columns are ignored; an empty table gives no rows. Words are runs
    without \\x20 and \\x09-\\x0D, told apart by their bytes.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_found(power, least), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def planted(text: Column, doc_id: Column) -> Column:
    """``text``, or for one in ten ids (crc32 of the id) its words from a place on repeated from there with a period; both follow from the crc32."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = ((h - F.pmod(h, F.lit(10))) / 10).cast("long")
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))).cast("int")
        tail = F.slice(w, a + 1, p)
        whole = F.flatten(F.array_repeat(tail, F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(whole, F.lit(1), (n - a).cast("int"))), " ")

    made = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))[0]
    return F.when(F.pmod(h, F.lit(10)) == 0, made).otherwise(text)


def run_digests(found: DataFrame) -> DataFrame:
    """``(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)`` of ``periodic_runs``: the longest run and digests.

    The longest run is that of greatest length, then smallest start, then smallest period; without a run these four are null.
    """
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.s")).cast("long").alias("start"), F.col("_best.n").cast("long").alias("length"), (-F.col("_best.p")).cast("long").alias("period"),
        F.expr("(1000L * _best.n) div -_best.p").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
