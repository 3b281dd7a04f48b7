"""Substring dedup: suffix automata over shards of repeated passages, past which the passages stream for matching statistics."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lexisift.llm.minhash import _MIX, _mixed
from lexisift.llm.shared import Scope, column_bytes, column_text, discard, mapped, row_key, written

#: Words of the anchor inside a window; words that one automaton takes; words of one anchor beyond which no automaton is built for it (its
#: states would take gigabytes), and beyond which its windows are no longer counted within one task (of some 100 MB) but dealt out singly.
ANCHOR, SHARD_WORDS, HOT_WORDS, TASK_WORDS = 8, 60_000, 30_000, 1_500_000

#: Tasks that the distinct passages of one anchor are dealt over where they meet its number of words.
SALTS = 32
#: Windows under a hot anchor that a worker holds at a time.
WINDOWS = 50_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BASE = 0x2545F4914F6CDD1D
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) <= n:
        size = 2 * n + 1024
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS


def word_hashes(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def passages(h: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same anchor: anchor, digest of the run's words, first window, number of windows, whether the anchor returns within.

    The anchor of a window is the least of its ``ANCHOR``-word fingerprints. Equal windows have equal anchors, wherever they are.
    """
    n = len(h) - width + 1
    k = min(ANCHOR, width)
    grams = len(h) - k + 1
    g = np.zeros(grams, np.uint64)
    for j in range(k):
        g = _mixed(g + h[j : grams + j] * _MIX[j % 8]) if j % 4 == 3 or j == k - 1 else g + h[j : grams + j] * _MIX[j % 8]
    span, least, reach = width - k + 1, g, 1
    while reach < span:
        step = min(reach, span - reach)
        least = np.minimum(least[: len(least) - step], least[step:])
        reach += step
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    ends = np.append(starts[1:], n)
    power, inverse = _powers(len(h))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[: len(h)])])
    digest = _mixed((sums[ends + width - 1] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _MIX[1])
    again = np.zeros(len(starts), bool)
    if len(np.unique(g)) < len(g):
        again[:] = [np.count_nonzero(g[a : b + span - 1] == v) > 1 for a, b, v in zip(starts, ends, least[starts], strict=True)]
    return least[starts], digest, starts, ends - starts, again


def _anchored(width: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, keys = (np.asarray(batch.column(batch.schema.get_field_index(k))) for k in ("_id", "_th"))
        parts = []
        for i, text in enumerate(column_bytes(batch, "text")):
            h = word_hashes(text)
            if len(h) >= width:
                v, d, start, count, again = passages(h, width)
                parts.append((v, d, np.full(len(v), i), start, count, again))
        if parts:
            v, d, row, start, count, again = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(d.view(np.int64)), pa.array(ids[row]), pa.array(keys[row]), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(again)], ["v", "d", "_id", "_th", "start", "n", "again"])

    return run


class Automaton:
    """Suffix automaton of weighted word sequences. ``times`` of a state: occurrences of its words, by weight, once ``close`` has run."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.times, self.last = [-1], [0], [0], 0

    def add(self, words: list[int], weight: int) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)
            self.times[last] += weight

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(w)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        self.times.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        nxt, link = self.next, self.link
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        self.length.append(self.length[p] + 1)
        self.times.append(0)
        link[q] = copy
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def close(self) -> None:
        for s in np.argsort(np.array(self.length), kind="stable")[:0:-1].tolist():
            self.times[self.link[s]] += self.times[s]

    def repeated(self, words: list[int], width: int) -> list[int]:
        """Starts of the windows of ``width`` words whose matching statistic reaches a state that occurs twice or more."""
        nxt, link, length, times, out = self.next, self.link, self.length, self.times, []
        s = matched = 0
        for i, w in enumerate(words):
            while s and w not in nxt[s]:
                s = link[s]
                matched = length[s]
            if w in nxt[s]:
                s, matched = nxt[s][w], matched + 1
            while length[link[s]] >= width if s else False:
                s = link[s]
                matched = length[s]
            if matched >= width and times[s] >= 2:
                out.append(i - width + 1)
        return out


def _runs(starts) -> list[int]:
    """Sorted numbers as flat pairs of first and last."""
    out: list[int] = []
    for x in starts:
        if out and out[-1] == x - 1:
            out[-1] = x
        else:
            out += [x, x]
    return out


def _matched(width: int):
    """One automaton for each shard; the rows of a shard follow one another and are bounded."""

    def flush(rows, out):
        if not rows:
            return
        machine = Automaton()
        for _, _, times, words in rows:
            machine.add(words, times)
        machine.close()
        for v, d, _, words in rows:
            if found := machine.repeated(words, width):
                out.append((v, d, _runs(found)))

    def run(batches):
        held, rows = None, []
        for batch in batches:
            out = []
            cols = [batch.column(i).to_pylist() for i in range(4)]
            words = [np.frombuffer(x, np.int64).tolist() for x in batch.column(4).to_pylist()]
            for shard, v, d, times, w in zip(*cols, words, strict=True):
                if shard != held:
                    flush(rows, out)
                    held, rows = shard, []
                rows.append((v, d, times, w))
            yield _found_batch(out)
        out = []
        flush(rows, out)
        yield _found_batch(out)

    return run


def _tallied(width: int):
    """Passages under a busy anchor: their windows by a digest of 128 bits, counted within the task; the rows of an anchor follow one another."""

    def flush(rows, out):
        digests = [[xxhash.xxh3_128_digest(raw[8 * o : 8 * (o + width)]) for o in range(len(raw) // 8 - width + 1)] for _, _, _, raw in rows]
        seen: dict[bytes, int] = {}
        for (_, _, times, _), own in zip(rows, digests, strict=True):
            for x in own:
                seen[x] = seen.get(x, 0) + times
        for (v, d, _, _), own in zip(rows, digests, strict=True):
            if found := [o for o, x in enumerate(own) if seen[x] > 1]:
                out.append((v, d, _runs(found)))

    def run(batches):
        held, rows = None, []
        for batch in batches:
            out = []
            for v, d, times, raw in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                if v != held:
                    flush(rows, out)
                    held, rows = v, []
                rows.append((v, d, times, raw))
            yield _found_batch(out)
        out = []
        flush(rows, out)
        yield _found_batch(out)

    return run


def _found_batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int32()))], ["v", "d", "found"])


def _cut_passages(width: int):
    """The words of the passages that a document stands for."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for text, wanted in zip(column_bytes(batch, "text"), batch.column(batch.schema.get_field_index("wanted")).to_pylist(), strict=True):
            h = word_hashes(text).view(np.int64)
            out += [(x["shard"], x["v"], x["d"], x["times"], h[x["start"] : x["start"] + x["n"] + width - 1].tobytes()) for x in wanted]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["shard", "v", "d", "times", "words"])

    return run


def _windowed(width: int):
    """The windows of passages under a hot anchor, one row each, by a digest of 128 bits; so many at a time as ``WINDOWS``."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        v, d, times = (batch.column(i) for i in (1, 2, 3))
        for i in range(batch.num_rows):
            raw = batch.column(4)[i].as_buffer()
            n = raw.size // 8 - width + 1
            for low in range(0, n, WINDOWS):
                high = min(n, low + WINDOWS)
                digests = b"".join(xxhash.xxh3_128_digest(raw[8 * o : 8 * (o + width)]) for o in range(low, high))
                w = np.frombuffer(digests, np.int64).reshape(-1, 2)
                one = lambda x: pa.array(np.full(high - low, x[i].as_py(), np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([one(v), one(d), one(times), pa.array(np.arange(low, high, dtype=np.int32)), pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy())], ["v", "d", "times", "o", "w1", "w2"])

    return run


def _stretches(rows: DataFrame) -> DataFrame:
    """``(v, d, found)`` of ``rows(v, d, o)``: numbers that follow one another as flat pairs of first and last, so that no list has every window."""
    order = Window.partitionBy("v", "d").orderBy("o")
    runs = rows.withColumn("_r", F.col("o") - F.row_number().over(order)).groupBy("v", "d", "_r").agg(F.min("o").alias("a"), F.max("o").alias("b"))
    return runs.groupBy("v", "d").agg(F.flatten(F.collect_list(F.array("a", "b"))).alias("found"))


def _spans(flat: list[int] | None) -> list[tuple[int, int]]:
    """Flat word spans, end excluded, as a sorted union."""
    flat, out = flat or [], []
    for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _digested(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    spans = batch.column(batch.schema.get_field_index("spans")).to_pylist()
    out = []
    for text, flat in zip(column_bytes(batch, "text"), spans, strict=True):
        words = text.split()
        n, cut = len(words), _spans(flat)
        for a, b in reversed(cut):
            del words[a:b]
        out.append((n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
    yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()), *(pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_passages(docs: DataFrame, width: int = 35, scope: Scope | None = None) -> DataFrame:
    """``(_id, _th, spans)``: flat pairs of word positions, end excluded, that windows occurring twice or more cover; for each text that has any.

    1. Each text is cut into runs of windows with the same anchor; equal windows have equal anchors, so an anchor that occurs once in the
       corpus (and doesn't return within its run) has no repeated window. What is left is the repeated passages and little more.
    2. Equal passages become one with a count, before the shuffle: copies are one row from here on.
    3. The distinct passages are the reference, cut into shards by anchor; a shard's task builds its suffix automaton, weighted with the
       counts, and streams the passages past it. Shards go to the passages that can match, not all to all: a broadcast reference would grow
       with the corpus, and the work with its square.
    Equal rows have equal spans, which are one before they meet: a group of copies of a row costs as much as it has rows.
    4. An anchor with more than ``HOT_WORDS`` words of distinct passages would be too large an automaton; its windows are counted by digest,
       within a task up to ``TASK_WORDS`` words, by a shuffle of single windows beyond.
    """
    scope = scope or Scope()
    keyed = docs.select("text", *row_key())
    runs = written(mapped(keyed, _anchored(width), "v long, d long, _id long, _th long, start int, n int, again boolean"), "passages")
    often = runs.groupBy("v").agg(F.count("*").alias("c"), F.max("again").alias("a")).where("c > 1 or a").select("v")
    near = scope.written(runs.join(often, "v", "left_semi"), "candidates")
    discard(runs)
    classes = near.groupBy("v", "d").agg(F.count("*").alias("times"), F.min(F.struct("_id", "_th", "start", "n")).alias("rep"))
    classes = scope.written(classes, "classes")
    words = F.sum(F.col("rep.n") + F.lit(width - 1)).alias("words")
    busiest = classes.groupBy("v").agg(words).where(F.col("words") > HOT_WORDS)  # few: each has that many words
    total = classes.agg(F.sum(F.col("rep.n") + F.lit(width - 1))).first()[0] or 0
    shards = 1 + int(total) // SHARD_WORDS
    shard = F.when(F.col("words") > TASK_WORDS, F.lit(-1)).when(F.col("words") > HOT_WORDS, F.lit(-2)).otherwise(F.pmod(F.xxhash64("v"), F.lit(shards))).cast("long")
    busiest = busiest.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = classes.withColumn("_salt", F.pmod(F.xxhash64("d"), F.lit(SALTS)).cast("int"))
    wanted = salted.join(busiest, ["v", "_salt"], "left").select("rep._id", "rep._th", F.struct(shard.alias("shard"), "v", "d", "times", F.col("rep.start").alias("start"), F.col("rep.n").alias("n")).alias("w"))
    wanted = wanted.groupBy("_id", "_th").agg(F.collect_list("w").alias("wanted"))
    texts = keyed.join(wanted, ["_id", "_th"]).dropDuplicates(["_id", "_th"]).select("text", "wanted")
    cut = scope.written(mapped(texts, _cut_passages(width), "shard long, v long, d long, times long, words binary"), "reference")
    found = cut.where("shard >= 0").repartition("shard").sortWithinPartitions("shard").mapInArrow(_matched(width), "v long, d long, found array<int>")
    busy = cut.where("shard = -2").repartition("v").sortWithinPartitions("v").mapInArrow(_tallied(width), "v long, d long, found array<int>")
    windows = mapped(cut.where("shard = -1"), _windowed(width), "v long, d long, times long, o int, w1 long, w2 long")
    common = windows.groupBy("w1", "w2").agg(F.sum("times").alias("c")).where("c > 1").select("w1", "w2")
    hot = _stretches(windows.join(common, ["w1", "w2"], "left_semi").select("v", "d", "o"))
    marks = found.unionByName(busy).unionByName(hot)
    spans = F.flatten(F.expr(f"transform(sequence(0, size(found) div 2 - 1), k -> array(start + found[2 * k], start + found[2 * k + 1] + {width}))"))
    return near.join(marks, ["v", "d"]).where("size(found) > 1").select("_id", "_th", spans.alias("s")).groupBy("_id", "_th").agg(F.flatten(F.collect_set("s")).alias("spans"))


def substring_dedup(docs: DataFrame, width: int = 35, scope: Scope | None = None) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` for each ``docs(doc_id, text)`` row, with every repeated window of ``width`` words removed.

    Windows are judged on the input. Words are runs without \\x20 and \\x09-\\x0D. Null and empty texts, and texts shorter than a window, keep
    what they have. Repeated rows repeat each other's windows and lose them, like copies under other ids. Rows of one id with different texts
    are told apart by the text. Empty tables give empty results; other columns are ignored. A task holds some 150 bytes a word of the longest
    text; windows of a text that repeats itself are dealt out and leave as stretches.
    """
    marked = repeated_passages(docs, width, scope)
    keyed = docs.select("doc_id", "text", *row_key()).join(marked, ["_id", "_th"], "left")
    return mapped(keyed.select("doc_id", "text", "spans"), _digested, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _trimmed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    get = lambda k: batch.column(batch.schema.get_field_index(k))
    out = []
    for text, flat in zip(column_text(batch, "text"), get("spans").to_pylist(), strict=True):
        if flat:
            words = [m.span() for m in _WORD.finditer(text)]
            parts, end = [], 0
            for a, b in _spans(flat):
                parts.append(text[end : words[a][0]])
                end = words[b - 1][1]
            text = "".join([*parts, text[end:]]).strip()
        out.append(text)
    yield pa.RecordBatch.from_arrays([get("_row"), pa.array(out, pa.string())], ["_row", "_cut"])


def without_repeats(docs: DataFrame, width: int = 35, scope: Scope | None = None) -> DataFrame:
    """``docs`` with all columns, repeated windows cut out of ``text``; rows of which nothing is left go.

    Null text is as empty. Repeated rows lose each other's windows; null ids, texts under one id and other columns stay as they are; an empty
    table gives an empty one.
    """
    marked = repeated_passages(docs, width, scope)
    whole = docs.select(F.struct(*docs.columns).alias("_row"), "text", *row_key())
    joined = whole.select("_row", "text", F.col("_id"), F.col("_th")).join(marked, ["_id", "_th"], "left").select("_row", "text", "spans")
    cut = mapped(joined, _trimmed, StructType([joined.schema["_row"], StructField("_cut", StringType())]))
    return cut.where(r"_cut rlike '[^\\x20\\x09-\\x0D]'").select(*[F.col("_cut").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
