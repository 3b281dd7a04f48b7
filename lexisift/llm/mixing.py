"""Mixing sources to target weights: a van der Corput schedule of equal blocks of words, joined with each source's shuffled stream of documents."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexisift.llm.shared import Scope

#: Words of a block; parts of a source's stream, and of the schedule, whose rows are numbered apart; copies of one row that are made in one go.
BLOCK_WORDS, PARTS, COPIES = 256, 4096, 4096
#: The weights of sources in order, repeating.
WEIGHTS = (5, 2, 1)

_KEY = ["s", "unnamed"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def bits_reversed(x: Column, bits: Column) -> Column:
    """The last ``bits`` bits of a number the other way round: the base-2 van der Corput sequence as integers. It is its own inverse."""
    for shift, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        low = F.lit(mask).cast("long")
        x = F.shiftleft(x.bitwiseAND(low), shift).bitwiseOR(F.shiftrightunsigned(x, shift).bitwiseAND(low))
    return F.call_function("shiftrightunsigned", x, (F.lit(64) - bits).cast("int"))


def targets(sizes: DataFrame, share: tuple[int, int] = (3, 2), most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sizes(s, unnamed, size)`` with ``target``, the double, and ``quota``, its whole words: the sources share ``share`` of all words by weight.

    A target stops at ``most`` times its source's size and its excess goes to the others by weight. In the order of size by weight, sources
    stop up to the first one whose part of what is left fits: that is where repeated resharing ends. Products are decimals of 38 digits.
    The sources, a row each, meet in one window; the documents don't.
    """
    up, down = share
    by_name, everything = Window.orderBy("unnamed", "s"), Window.partitionBy()
    by_ratio = Window.orderBy(F.col("size").cast("decimal(25,0)") * F.lit(math.lcm(*weights)) / F.col("w"), "unnamed", "s")
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    row = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")).cast("long"))
    # in units of 1 / down: what the sources up to here leave, if they all stop, and the weights of the others
    row = row.withColumn("left", F.lit(up) * F.sum("size").over(everything) - F.lit(most * down) * before("size")).withColumn("rest", F.sum("w").over(everything) - before("w"))
    row = row.withColumn("stops", F.expr(f"cast(left as decimal(19, 0)) * w > cast(rest as decimal(19, 0)) * {most * down} * size"))
    row = row.withColumn("free", F.max(F.when(~F.col("stops"), F.struct("rest", "left"))).over(everything))
    return row.select(
        *_KEY, "size",
        F.when(F.col("stops"), (F.lit(most) * F.col("size")).cast("double")).otherwise(F.expr(f"cast(cast(free.left as decimal(19, 0)) * w as double) / cast(free.rest * {down} as double)")).alias("target"),
        F.when(F.col("stops"), F.lit(most) * F.col("size")).otherwise(F.expr(f"(cast(free.left as decimal(19, 0)) * w) div (free.rest * {down})")).alias("quota"),
    )


def _before(rows: DataFrame, amount: Column) -> DataFrame:
    """``(s, unnamed, part, begin, total)``: of each source's parts the sum of ``amount`` before it, and that of the whole source."""
    sums, own = rows.groupBy(*_KEY, "part").agg(F.sum(amount).alias("_n")), Window.partitionBy(*_KEY)
    begin = F.coalesce(F.sum("_n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sums.select(*_KEY, "part", begin.alias("begin"), F.sum("_n").over(own).alias("total"))


def streams(docs: DataFrame, share: tuple[int, int] = (3, 2), most: int = 2, weights: tuple[int, ...] = WEIGHTS, scope: Scope | None = None) -> DataFrame:
    """``(s, unnamed, doc_id, size, at, source_size, target, quota)``: each row's place, in words, in the shuffled stream of its source.

    The order is by a digest of the id, so the parts of a stream have like numbers of rows, and what is known of a source reaches its rows by
    part: a source with a third of all rows is many keys. Equal rows are one with a count until they have their places.
    """
    scope = scope or Scope()
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("unnamed"), word_count(F.col("text")).alias("size"))
    sized = sized.groupBy("doc_id", *_KEY, "size").agg(F.count("*").alias("n")).withColumn("k", key).withColumn("part", F.floor(F.col("k") / (2**60 // PARTS)).cast("int"))
    sized = scope.written(sized, "sized")
    words = F.col("n") * F.col("size")
    parts = _before(sized, words)
    known = targets(parts.groupBy(*_KEY).agg(F.max("total").alias("size")), share, most, weights)
    parts = parts.join(known.select(*_KEY, "target", "quota"), _KEY)
    place = Window.partitionBy(*_KEY, "part").orderBy("k", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("at", F.coalesce(F.sum(words).over(place), F.lit(0))).join(parts, [*_KEY, "part"])
    placed = placed.select(*_KEY, "doc_id", "size", (F.col("at") + F.col("begin")).alias("at"), F.col("total").alias("source_size"), "target", "quota", "n")
    every = lambda low, high: F.explode(F.sequence(low, high))
    few = placed.where(F.col("n") <= COPIES).withColumn("c", every(F.lit(0).cast("long"), F.col("n") - 1))
    many = placed.where(F.col("n") > COPIES).withColumn("c", every(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))).repartition(*_KEY, "at", "c")
    many = many.withColumn("c", every(F.col("c") * COPIES, F.least(F.col("n"), (F.col("c") + 1) * COPIES) - 1))
    return few.unionByName(many).withColumn("at", F.col("at") + F.col("c") * F.col("size")).drop("c", "n")


def schedule(sources: DataFrame) -> DataFrame:
    """``(s, unnamed, slot, block)`` of ``sources(s, unnamed, quota)``: each source's blocks of ``BLOCK_WORDS`` words in the order of the mix.

    Sources take adjoining intervals of whole points, one for each block, so the weights are met exactly. Slot ``t`` goes to the source whose
    interval holds the reversed bits of ``t``; as reversing is its own inverse, each source's points are reversed instead of joining slots
    with intervals. Points beyond the last interval are slots that nothing fills. Slots are then ranked per source, part by part.
    """
    blocks = F.expr(f"(quota + {BLOCK_WORDS - 1}) div {BLOCK_WORDS}")
    before = F.coalesce(F.sum("blocks").over(Window.orderBy("unnamed", "s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    row = sources.select(*_KEY, blocks.alias("blocks")).withColumn("low", before).withColumn("bits", F.greatest(F.lit(1), F.ceil(F.log2(F.sum("blocks").over(Window.partitionBy()) + 1))).cast("int"))
    step = 1 << 16
    points = row.where("blocks > 0").withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(blocks - 1) div {step}")))).repartition(*_KEY, "c")
    points = points.withColumn("x", F.explode(F.sequence(F.col("low") + F.col("c") * step, F.col("low") + F.least(F.col("blocks"), (F.col("c") + 1) * step) - 1)))
    slots = points.select(*_KEY, bits_reversed(F.col("x"), F.col("bits")).alias("slot"), "bits")
    slots = slots.select(*_KEY, "slot", F.floor(F.col("slot") * PARTS / F.pow(F.lit(2.0), F.col("bits"))).cast("int").alias("part"))
    rank = F.row_number().over(Window.partitionBy(*_KEY, "part").orderBy("slot")) - 1
    # Spark takes exploded rows for as few as those before: both sides grow with the input and are never broadcast
    return slots.withColumn("rank", rank).join(_before(slots, F.lit(1)).hint("merge"), [*_KEY, "part"]).select(*_KEY, "slot", (F.col("rank") + F.col("begin")).alias("block"))


def mixture(stream: DataFrame, most: int = 2) -> DataFrame:
    """``(slot, s, unnamed, doc_id, at, size, first, words)``: the pieces of documents that the mix takes, a slot's pieces in the order of ``at``.

    A source's stream goes round ``most`` times at most and ends at its quota; cut into blocks it is joined with the slots of the schedule.
    ``first`` is a piece's first word in its document.
    """
    sources = stream.groupBy(*_KEY).agg(F.max("quota").alias("quota"))
    lap = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long")))
    laps = stream.where("size > 0").withColumn("lap", lap).withColumn("from", F.col("at") + F.col("lap") * F.col("source_size")).withColumn("to", F.least(F.col("from") + F.col("size"), F.col("quota")))
    cut = laps.where(F.col("from") < F.col("to")).withColumn("block", F.explode(F.expr(f"sequence(from div {BLOCK_WORDS}, (to - 1) div {BLOCK_WORDS})")))
    first = F.greatest("from", F.col("block") * BLOCK_WORDS)
    words = F.least("to", (F.col("block") + 1) * BLOCK_WORDS) - first
    pieces = cut.select(*_KEY, "block", "doc_id", "at", "size", (first - F.col("from")).alias("first"), words.alias("words"))
    return pieces.join(schedule(sources).hint("merge"), [*_KEY, "block"]).select("slot", *_KEY, "doc_id", "at", "size", "first", "words")


def mixed(docs: DataFrame, share: tuple[int, int] = (3, 2), most: int = 2, weights: tuple[int, ...] = WEIGHTS, scope: Scope | None = None) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` for each row of ``docs(doc_id, text, source)``: the words of it that the mix takes.

    Sizes are numbers of words. Sources by code point, null last, weigh ``weights``, repeating, and share ``share`` of all words (``targets``).
    Each source's stream is its documents in shuffled order; the mix takes its first ``quota`` words, going round again where the target is above
    the size, in blocks that the schedule places (``mixture``). So each source's taken words are its target without the fraction, and no
    document exceeds ``most`` times its size.

    Null and empty texts have no words and nothing is taken of them. Rows without an id come where the digest of an empty id puts them.
    Repeated rows lie behind one another in the stream, whichever is which. Without words all targets are 0. A very long text is cut into
    blocks like any other. An empty table gives no rows; other columns are ignored. Reruns give the same rows.
    """
    scope = scope or Scope()
    stream = scope.written(streams(docs, share, most, weights, scope), "stream")
    row = [*_KEY, "at", "size"]
    taken = mixture(stream, most).groupBy(*row).agg(F.sum("words").alias("taken"))
    whole = stream.join(taken.hint("merge"), row, "left")
    return whole.select("doc_id", F.when(~F.col("unnamed"), F.col("s")).alias("source"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
