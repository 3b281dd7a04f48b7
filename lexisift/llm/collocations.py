"""Phrase collocations: fragments go to the rarest word of their phrases (pivot partitioning), which mines the phrases that it owns."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexisift.llm.shared import Scope, column_bytes

#: Bytes of text that are cut into fragments together; slots of the table of frequencies; occurrences of a word beyond which it has several
#: partitions; different phrases of a partition that are counted in memory before partial counts go out.
SEGMENT, SLOTS, PIVOT_ROWS, HELD = 1 << 20, 1 << 20, 200_000, 300_000

_PIECES = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
_SEED = 42  # of Spark's xxhash64


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def word_hash(lang: bytes, word: bytes) -> int:
    """Spark's ``xxhash64(lang, word)``, without sign."""
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang, _SEED))


def segments(text: bytes, reach: int, size: int = SEGMENT) -> Iterator[tuple[list[bytes | None], int, int]]:
    """The words of a text in lower case, with None between pieces, in bounded lists, and the range of each list that is its own.

    What is outside of the range are words of the lists before and after, as many as a phrase of ``reach + 1`` words can reach.
    """
    text = text.lower().translate(_PIECES)
    at, low, words = 0, 0, []
    while True:
        end = at + size
        if end < len(text):
            end = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end)) + 1
            if not end:  # a word is longer than a segment
                end = min((x for x in (text.find(b" ", at + size), text.find(b"\n", at + size)) if x >= 0), default=len(text)) + 1
        for k, piece in enumerate(text[at:end].split(b"\n")):
            if k:
                words.append(None)
            words += piece.split()
        at, last = end, end >= len(text)
        high = len(words) if last else len(words) - reach
        if last or high > low:
            yield words, low, high
            words, low = words[max(0, high - reach) :], min(reach, high)
        if last:
            return


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[bytes]]]:
    groups: dict[bytes, list[bytes]] = {}
    for lang, text in zip(column_bytes(batch, "lang"), column_bytes(batch, "text"), strict=True):
        groups.setdefault(lang, []).append(text)
    yield from groups.items()


def _counted(batches):
    for batch in batches:
        for lang, texts in _by_lang(batch):
            held: Counter = Counter()

            def out() -> pa.RecordBatch:
                held.pop(None, None)
                n = len(held)
                columns = [pa.array([lang] * n, pa.binary()).cast(pa.string()), pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())]
                held.clear()
                return pa.RecordBatch.from_arrays(columns, ["lang", "word", "c"])

            for text in texts:
                for words, low, high in segments(text, 0):
                    held.update(words[low:high])
                    if len(held) > HELD:
                        yield out()
            yield out()


def fragments(words: list[bytes | None], low: int, high: int, lang: bytes, most: np.ndarray, least: int, longest: int) -> Iterator[tuple[bytes, int, int, bytes]]:
    """``(pivot, hash, partitions, fragments)`` of a list of words: each fragment on a line, with its count after a tab if it occurs again.

    ``most`` has a bound on the frequency for each slot of hashes: words under ``least`` break a text, rarer words own phrases. A fragment is
    an occurrence of its pivot with the more frequent words around it, as far as a phrase reaches: before it only words that come earlier in
    the order, after it also the pivot itself, so that a phrase with several of them is found at its first.
    """
    ids: dict = {None: 0}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    names = list(ids)
    hashes = np.array([0, *(word_hash(lang, w) for w in names[1:])], np.uint64)
    often = most[hashes % np.uint64(len(most))]
    often[0] = 0
    order = np.lexsort((hashes, -often))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    blank = len(order) + 1
    rank[often < least] = blank  # rarer than any pivot
    r = np.concatenate([np.full(longest, blank), rank[codes], np.full(longest, blank)])
    own, reach = r[longest:-longest], longest - 1
    before, after = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    open_before, open_after = own < blank, own < blank
    for k in range(1, reach + 1):
        open_before &= r[longest - k : len(r) - longest - k] < own
        open_after &= r[longest + k : len(r) - longest + k] <= own
        before += open_before
        after += open_after
    at = np.flatnonzero((before + after > 0) & (np.arange(len(own)) >= low) & (np.arange(len(own)) < high))
    if not len(at):
        return
    sizes = np.fromiter((len(w) + 1 if w is not None else 1 for w in words), np.int64, len(words))
    ends = np.cumsum(sizes)
    text = b" ".join(b"" if w is None else w for w in words) + b" "
    starts = (ends - sizes)[at - before[at]].tolist()
    stops = (ends[at + after[at]] - 1).tolist()
    found = [text[a:b] for a, b in zip(starts, stops)]
    pivots = dict(zip(found, codes[at].tolist()))
    counts = Counter(found)
    kinds, pivot = list(pivots), np.fromiter(pivots.values(), np.int64, len(pivots))
    by = np.argsort(pivot, kind="stable")
    pivot = pivot[by]
    edges = np.append(np.flatnonzero(np.concatenate([[True], pivot[1:] != pivot[:-1]])), len(pivot)).tolist()
    parts = (often // PIVOT_ROWS + 1).tolist()
    by, pivot = by.tolist(), pivot.tolist()
    for a, b in zip(edges, edges[1:]):
        lines = [kinds[i] if counts[kinds[i]] == 1 else b"%b\t%d" % (kinds[i], counts[kinds[i]]) for i in by[a:b]]
        yield names[pivot[a]], int(hashes[pivot[a]]), parts[pivot[a]], b"\n".join(lines)


def _routed(most, least: int, longest: int):
    """Rows of fragments; a word of several partitions sends those of a list to one of them, by their digest."""

    def run(batches):
        table = most.value
        for batch in batches:
            for lang, texts in _by_lang(batch):
                held: list[bytes | None] = []

                def out(words, low, high) -> pa.RecordBatch:
                    rows = list(fragments(words, low, high, lang, table, least, longest))
                    key = [(h + (xxhash.xxh3_64_intdigest(x) % parts) * 0x9E3779B97F4A7C15) % 2**64 for _, h, parts, x in rows]
                    text = lambda i: pa.array([r[i] for r in rows], pa.binary()).cast(pa.string())
                    columns = [pa.array(_signed(np.array(key, np.uint64))), pa.array([lang] * len(rows), pa.binary()).cast(pa.string()), text(0), pa.array([r[2] > 1 for r in rows], pa.bool_()), text(3)]
                    return pa.RecordBatch.from_arrays(columns, ["key", "lang", "pivot", "shared", "fragments"])

                size = 0
                for text in texts:
                    for words, low, high in segments(text, longest - 1):
                        if low or high < len(words):
                            yield out(words, low, high)
                            continue
                        held += [*words, None]
                        size += len(text)
                        if size > SEGMENT:
                            yield out(held, 0, len(held))
                            held, size = [], 0
                if held:
                    yield out(held, 0, len(held))

    return run


def owned(fragment: bytes, pivot: bytes, longest: int) -> Iterator[bytes]:
    """The phrases of two words or more in a fragment that hold its pivot's first occurrence."""
    words = fragment.split(b" ")
    i, n = words.index(pivot), len(words)
    for a in range(max(0, i - longest + 1), i + 1):
        for b in range(max(i + 1, a + 2), min(n, a + longest) + 1):
            yield b" ".join(words[a:b])


def _mined(least: int, longest: int):
    """Phrases of each partition, whose rows follow one another, with their counts; counts that may be parts go out whatever they are."""

    def run(batches):
        held, partial, lines, grams = None, False, Counter(), Counter()
        out: list[tuple[bytes, bytes, int]] = []

        def mine() -> None:
            for line, n in lines.items():
                fragment, _, c = line.partition(b"\t")
                n *= int(c) if c else 1
                for gram in owned(fragment, held[2], longest):
                    grams[gram] += n
            lines.clear()

        def flush() -> None:
            if held is not None:
                out.extend((held[1], gram, c) for gram, c in grams.items() if partial or c >= least)
            grams.clear()

        def sent() -> pa.RecordBatch:
            columns = [pa.array([r[0] for r in out], pa.binary()).cast(pa.string()), pa.array([r[1] for r in out], pa.binary()).cast(pa.string()), pa.array([r[2] for r in out], pa.int64())]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "c"])

        for batch in batches:
            keys, shared = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            for key, lang, pivot, several, blob in zip(keys, column_bytes(batch, "lang"), column_bytes(batch, "pivot"), shared, column_bytes(batch, "fragments"), strict=True):
                if (key, lang, pivot) != held:
                    mine()
                    flush()
                    held, partial = (key, lang, pivot), several
                lines.update(blob.split(b"\n"))
                if len(lines) > HELD:
                    mine()
                    if len(grams) > HELD:
                        partial = True
                        flush()
                        yield sent()
                if len(out) > HELD:
                    yield sent()
        mine()
        flush()
        yield sent()

    return run


def frequencies(spark: SparkSession, words: DataFrame) -> np.ndarray:
    """For each of ``SLOTS`` slots of hashes the largest count of a word in it: never below a word's own count, 8 MB whatever the vocabulary."""
    slots = words.groupBy(F.pmod(F.xxhash64("lang", "word"), F.lit(SLOTS)).cast("int").alias("slot")).agg(F.max("c").alias("c")).toArrow()
    most = np.zeros(SLOTS, np.int64)
    most[np.asarray(slots.column("slot"))] = np.asarray(slots.column("c"))
    return most


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10, scope: Scope | None = None) -> tuple[DataFrame, DataFrame]:
    """``(lang, word, c)`` of all words and ``(lang, phrase, c)`` of the phrases of 2 to ``longest`` words that occur ``least`` times or more.

    1. Words are counted; of the counts the driver sees ``SLOTS`` maxima at most, which tell how rare a word is: exactly, unless a more
       frequent word shares its slot. Any order of words gives the right counts, a rarer pivot only spreads them better.
    2. A text goes, as fragments, to the pivots of its phrases, their rarest words; words that are too rare for any phrase break it. Equal
       fragments are one with a count before the shuffle, those of a pivot one row.
    3. Each pivot's partition counts the phrases it owns; a pivot with more than ``PIVOT_ROWS`` occurrences has several partitions. Their
       counts, and those of partitions that would outgrow memory, are parts, which are added up by phrase.
    """
    scope = scope or Scope()
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = scope.written(texts.mapInArrow(_counted, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c")), "words")
    most = spark.sparkContext.broadcast(frequencies(spark, words))
    rows = texts.mapInArrow(_routed(most, least, longest), "key long, lang string, pivot string, shared boolean, fragments string")
    mined = rows.repartition("key").sortWithinPartitions("key", "lang", "pivot").mapInArrow(_mined(least, longest), "lang string, phrase string, c long")
    return words, scope.written(mined.groupBy("lang", "phrase").agg(F.sum("c").alias("c")).where(F.col("c") >= least), "phrases")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, inside: int = 50, top: int = 2000, scope: Scope | None = None) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: of each language of ``docs(text, lang)`` the ``top`` phrases by score.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends and into words at blanks and tabs; phrases don't leave a piece.
    A phrase of 2 to ``longest`` words that occurs ``a >= least`` times scores ``floor(1000000 * a * a / (l * r))`` at its worst cut into a
    first part (``l`` times) and the rest (``r`` times); ties go to the shortest first part. It goes if a longer phrase of these that contains
    it occurs ``inside`` percent as often or more. ``n`` is the number of the language's words. Order: score, ``a``, then the phrase's bytes.

    Null texts are empty, a null language is ``und``; repeated rows count again; other columns are ignored; an empty table gives no rows. Long
    texts are read in segments (``SEGMENT`` bytes). A frequent word as a part is a join key that adaptive execution can split; the best of a
    language are picked from 64 parts before they meet. Products are decimals of 38 digits: counts up to 10^16 are exact.
    """
    scope = scope or Scope()
    words, phrases = phrase_counts(docs, longest, least, scope)
    totals = words.groupBy("lang").agg(F.sum("c").alias("n"))
    counts = words.where(F.col("c") >= least).unionByName(phrases.withColumnRenamed("phrase", "word"))
    w = F.split("phrase", " ")
    joined = lambda x: F.array_join(x, " ")
    cuts = phrases.select("lang", "phrase", F.col("c").alias("a"), w.alias("w")).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.slice("w", F.lit(1), F.col("k"))).alias("first"), joined(F.slice("w", F.col("k") + 1, F.size("w"))).alias("rest"))
    cuts = cuts.join(counts.select("lang", F.col("word").alias("first"), F.col("c").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("word").alias("rest"), F.col("c").alias("r")), ["lang", "rest"])
    exact = lambda c: f"cast({c} as decimal(16,0))"
    cuts = cuts.withColumn("score", F.expr(f"(cast({exact('a')} * {exact('a')} as decimal(32,0)) * 1000000) div (cast({exact('l')} * {exact('r')} as decimal(32,0)))"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("m")).select("lang", "phrase", "m.*")
    # the most frequent longer phrase around each
    spans = F.expr("filter(flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' ')))), x -> true)")
    inner = phrases.select("lang", F.col("c").alias("around"), w.alias("w")).where(F.size("w") > 2).select("lang", "around", F.explode(F.array_distinct(spans)).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    left = scored.join(inner, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("around") < inside * F.col("a"), F.lit(True)))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    left = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top).drop("part")
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return left.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
