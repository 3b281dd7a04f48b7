"""Benchmark decontamination: a prefix-filtered set join of documents with item windows, verified exactly."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisift.llm.shared import column_bytes, mapped, row_key

#: Item words that are sent to the executors at a time; more items go in further blocks, each against all documents.
BLOCK_WORDS = 1_000_000

_KEEP = b"".join(bytes([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32]) for c in range(256))


def item_words(text: bytes) -> list[bytes]:
    """Lower-case runs of ASCII letters, digits and all characters beyond ASCII."""
    return text.translate(_KEEP).split()


@dataclass
class Index:
    """The windows of a block of items, as numbers of words, filed under their prefix word: arrays of some 60 bytes a word of the block.

    ``words`` are the block's distinct words; ``windows[k]`` holds the distinct windows of ``k`` words, a row each, ordered by prefix word;
    ``places[k]`` where in each the prefix word stands, and ``first[k]`` where a word's windows begin. ``owners`` gives the items of a window.
    """

    words: list[bytes]
    windows: dict[int, np.ndarray]
    places: dict[int, np.ndarray]
    first: dict[int, np.ndarray]
    owners: dict[int, tuple[np.ndarray, np.ndarray]]  # begins of each window's items, item numbers
    items: list[str | None]

    def __post_init__(self):
        self.number = None

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if self.number is None:
            self.number = {w: i for i, w in enumerate(self.words)}
        get = self.number.get
        return np.fromiter((get(w, -1) for w in words), np.int32, len(words))

    def __getstate__(self):
        return {**self.__dict__, "number": None}


def _cut(items: list[tuple[str | None, bytes]]) -> tuple[list[bytes], list[tuple[str | None, np.ndarray]]]:
    """Distinct words of the items, and each item as their numbers."""
    number: dict[bytes, int] = {}
    cut = [(item_id, np.array([number.setdefault(w, len(number)) for w in item_words(text)], np.int32)) for item_id, text in items]
    return list(number), [(i, w) for i, w in cut if len(w)]


def _rarity(vocabulary):
    def run(batches):
        known, seen = frozenset(vocabulary.value), Counter()
        for batch in batches:
            for text in column_bytes(batch, "text"):
                seen.update(known.intersection(item_words(text)))
        words, counts = list(seen), list(seen.values())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["word", "n"])

    return run


def _index(words: list[bytes], items: list[tuple[str | None, np.ndarray]], rarity: np.ndarray, width: int) -> Index:
    """Windows under their necessary prefix token. All of a window must occur, so of its tokens by rarity the first one is prefix enough."""
    names = sorted({i for i, _ in items}, key=lambda i: (i is None, i))
    place = {name: k for k, name in enumerate(names)}
    order = np.empty(len(words), np.int64)  # rank of a word by rarity, then by its bytes
    order[np.lexsort((np.argsort(np.argsort(np.array(words, object))), rarity))] = np.arange(len(words))
    out = Index(words, {}, {}, {}, {}, names)
    for k in sorted({min(width, len(w)) for _, w in items}):
        own = [(place[i], w) for i, w in items if min(width, len(w)) == k]
        rows = np.concatenate([sliding_window_view(w, k) for _, w in own])
        owner = np.concatenate([np.full(len(w) - k + 1, i, np.int32) for i, w in own])
        possible = (rarity[rows] > 0).all(axis=1)  # a word that no document has rules its windows out
        rows, owner = rows[possible], owner[possible]
        if not len(rows):
            continue
        rows, which = np.unique(rows, axis=0, return_inverse=True)
        at = order[rows].argmin(axis=1)
        prefix = rows[np.arange(len(rows)), at]
        by = np.argsort(prefix, kind="stable")
        back = np.empty(len(by), np.int64)
        back[by] = np.arange(len(by))
        pairs = np.unique(np.stack([back[which.ravel()], owner], axis=1), axis=0)
        out.windows[k], out.places[k] = rows[by], at[by].astype(np.int32)
        out.first[k] = np.searchsorted(prefix[by], np.arange(len(words) + 1)).astype(np.int32)
        out.owners[k] = np.searchsorted(pairs[:, 0], np.arange(len(by) + 1)).astype(np.int32), pairs[:, 1].astype(np.int32)
    return out


def _found(words: list[bytes], index: Index) -> tuple[list[tuple[int, int]], set]:
    """Spans of a document's words that windows cover, and the items of these windows."""
    spans, ids = [], set()
    own = index.numbers(words)
    known = np.flatnonzero(own >= 0)
    for k, windows in index.windows.items():
        first = index.first[k]
        low, high = first[own[known]], first[own[known] + 1]
        at, low, n = known[high > low], low[high > low], (high - low)[high > low]
        for begin, end in _chunks(n):
            p = np.repeat(at[begin:end], n[begin:end])
            w = np.repeat(low[begin:end], n[begin:end]) + np.arange(len(p)) - np.repeat(np.cumsum(n[begin:end]) - n[begin:end], n[begin:end])
            start = p - index.places[k][w]
            fits = (start >= 0) & (start + k <= len(own))  # position and length bounds, then the words
            start, w = start[fits], w[fits]
            for j in range(k):
                same = own[start + j] == windows[w, j]
                start, w = start[same], w[same]
            for a in np.unique(start).tolist():
                spans.append((a, a + k))
            begins, owners = index.owners[k]
            for x in np.unique(w).tolist():
                ids.update(index.items[i] for i in owners[begins[x] : begins[x + 1]].tolist())
    return spans, ids


def _chunks(n: np.ndarray, most: int = 200_000) -> Iterator[tuple[int, int]]:
    """Ranges of positions with some ``most`` candidates each, one position at least."""
    if not len(n):
        return
    cuts = np.flatnonzero(np.diff((np.cumsum(n) - 1) // most)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(n)], strict=True)


def _union(spans: list[tuple[int, int]]) -> int:
    total, end = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def _verdict(words: int, spans: list[tuple[int, int]], ids: set) -> tuple:
    names = sorted({str(x) for x in ids if x is not None})
    hit = _union(spans)
    return words, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0


def _scanned(index):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own, out = index.value, []
        for text in column_bytes(batch, "text"):
            words = item_words(text)
            out.append(_verdict(len(words), *_found(words, own)))
        cols = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()), *cols], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return run


def _partial(index):
    """Of each document that has any: the spans and items found in this block."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own, rows = index.value, []
        for i, text in enumerate(column_bytes(batch, "text")):
            spans, ids = _found(item_words(text), own)
            if spans:
                rows.append((i, [x for s in spans for x in s], [x for x in ids if x is not None]))
        keys = [batch.column(batch.schema.get_field_index(k)).take(pa.array([r[0] for r in rows], pa.int64())) for k in ("_id", "_th")]
        yield pa.RecordBatch.from_arrays([*keys, pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.list_(pa.string()))], ["_id", "_th", "spans", "ids"])

    return run


def _closed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    get = lambda k: batch.column(batch.schema.get_field_index(k))
    out = []
    for text, spans, ids in zip(column_bytes(batch, "text"), get("spans").to_pylist(), get("ids").to_pylist(), strict=True):
        flat = spans or []
        out.append(_verdict(len(item_words(text)), list(zip(flat[::2], flat[1::2], strict=True)), set(ids or [])))
    cols = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)]
    yield pa.RecordBatch.from_arrays([get("doc_id").cast(pa.int64()), *cols], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _indexed(docs: DataFrame, items: DataFrame, width: int, block_words: int) -> list:
    """Broadcast window indexes of the items, a block each; rarity is counted over all documents."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.sum(F.ceil((F.octet_length("text") + 1) / 2))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_words))
    out = []
    for b in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        words, cut = _cut([(r[0], (r[1] or "").encode()) for r in own.collect()])  # block_words at most, in the mean
        vocabulary = spark.sparkContext.broadcast(words)
        counts = docs.select("text").mapInArrow(_rarity(vocabulary), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
        rarity = {bytes(r[0]): r[1] for r in counts.collect()}  # words of the block at most
        out.append(spark.sparkContext.broadcast(_index(words, cut, np.array([rarity.get(w, 0) for w in words], np.int64), width)))
        vocabulary.unpersist()
    return out


def decontaminated(docs: DataFrame, items: DataFrame, width: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """What each ``docs(doc_id, text)`` row holds of ``items(item_id, text)``: words hit, items, their digest, and whether it is contaminated.

    A window is ``width`` consecutive item words; an item of fewer is one window. Windows are filed under their rarest word, by the number
    of documents that have it; a document is held against those windows only whose word it has, where they fit by position and length, and
    then word by word. Nothing is shuffled but the word counts, with the documents read twice.

    Items are counted first and sent to the executors in blocks of ``block_words`` words (hashed by item); each block goes against all
    documents, and the findings of a document are brought together.

    Null or empty texts have no words; an item without words has no window. Items with a null id are hit like others but not listed; equal
    ids count once. Repeated rows give repeated results. Empty tables on either side give no hits. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    indexes = _indexed(docs, items, width, block_words)
    if len(indexes) == 1:
        return mapped(docs, _scanned(indexes[0]), SCHEMA)
    keyed = docs.select("doc_id", "text", *row_key())
    parts = None
    for index in indexes:
        part = mapped(keyed.dropDuplicates(["_id", "_th"]), _partial(index), "_id long, _th long, spans array<int>, ids array<string>")
        parts = part if parts is None else parts.unionByName(part)
    parts = parts.groupBy("_id", "_th").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    return mapped(keyed.join(parts, ["_id", "_th"], "left").select("doc_id", "text", "spans", "ids"), _closed, SCHEMA)


def _clean(index):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = index.value
        yield batch.filter(pa.array([not _found(item_words(t), own)[0] for t in column_bytes(batch, "text")], pa.bool_()))

    return run


def without_contaminated(docs: DataFrame, items: DataFrame, width: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text holds no window of any item; no shuffle but that of the word counts."""
    for index in _indexed(docs, items, width, block_words):
        docs = mapped(docs, _clean(index), docs.schema)
    return docs
