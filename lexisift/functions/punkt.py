"""Sentence boundaries learned from a corpus without labels (Kiss and Strunk, 2006): abbreviations, collocations, sentence starters, orthography.

Training is a few aggregates over the corpus; what it learns is a table that grows with the vocabulary. A model that the driver can hold goes into one
expression over a text's words (``Punkt``); ``sentences_of`` splits the corpus itself by joins, with a model of any size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisift.session import delete, written

#: Thresholds of the published algorithm: abbreviations, collocations, sentence starters.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
#: Pairs of words, the most frequent ones, whose boundaries every task holds; other pairs meet theirs in a shuffle.
HOT = 250_000
#: The type of all numbers.
NUMBER = "##"
#: A word that may end a sentence has a mark, and perhaps closing quotes or brackets; of these a word that does for certain.
MARKED, LOUD = r"""[.!?]["'”’»)\]]*$""", r"""[!?]["'”’»)\]]*$"""
#: What is outside of a word, a number, one letter, a capital, a small letter.
OUTSIDE, DIGITS, LETTER, UPPER, LOWER = r"^[^\pL\pN.]+|[^\pL\pN.]+$", r"^\pN[\pN.,:/-]*$", r"^\pL$", r"^[^\pL\pN]*\p{Lu}", r"^[^\pL\pN]*\p{Ll}"
#: ``MARKED`` as Python says it: Java's ``$`` also stands before one last line end. Different pairs that a task holds before partial counts go out.
_MARK, _SHOUT, HELD = *(re.compile(x.removesuffix("$") + "[\u0085\u2028\u2029]?\\Z") for x in (MARKED, LOUD)), 300_000
#: Bytes of parts of texts that a task holds before they go out.
OUT = 1 << 24


def _text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _core(x: str) -> str:
    return f"regexp_replace({x}, {_text(OUTSIDE)}, '')"


def _let(value: str, name: str, body: str) -> str:
    """SQL of ``body``, in which ``name`` stands for a value that is made once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _of_core(core: str, name: str = "_b") -> str:
    """The type of a word whose core is given."""
    return _let(f"lower(regexp_replace({core}, {_text('[.]+$')}, ''))", name, f"if({name} rlike {_text(DIGITS)}, '{NUMBER}', {name})")


def described(rows: DataFrame, word: str, prefix: str = "") -> DataFrame:
    """``rows`` with what the algorithm knows of a column of words: type (lower case, no final period), final period, several, one letter, case."""
    rows = rows.withColumn(prefix + "core", F.expr(_core(word))).withColumn(prefix + "type", F.expr(_of_core(prefix + "core")))
    named = {"dot": rf"{prefix}core rlike {_text('[^.][.]$')}", "dots": rf"{prefix}core rlike {_text('[.][.]$')}", "letter": f"{prefix}type rlike {_text(LETTER)}", "loud": f"{word} rlike {_text(LOUD)}", "upper": f"{word} rlike {_text(UPPER)}", "lower": f"{word} rlike {_text(LOWER)}"}
    return rows.withColumns({prefix + k: F.expr(f"coalesce({sql}, false)") for k, sql in named.items()})


class _Marked(dict):
    """Whether a word may end a sentence, or what else a pattern says, each word decided once."""

    def __init__(self, pattern: re.Pattern = _MARK):
        self.pattern = pattern

    def __missing__(self, word: bytes) -> bool:
        self[word] = found = bool(self.pattern.search(word.decode()))
        return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    marked, held = _Marked(), Counter()

    def out() -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in held], pa.binary()).cast(pa.string()) for i in (0, 1)]
        columns.append(pa.array(list(held.values()), pa.int64()))
        held.clear()
        marked.clear()
        return pa.RecordBatch.from_arrays(columns, ["before", "word", "c"])

    for batch in batches:
        for text in batch.column(0).cast(pa.binary()):
            words = (text.as_py() or b"").split()  # at white space of ASCII, as one_space and a blank
            held.update(zip([None, *[w if marked[w] else b"" for w in words[:-1]]], words))
            if len(held) > HELD:
                yield out()
    yield out()


def word_pairs(docs: DataFrame) -> DataFrame:
    """``(before, word, c)`` of ``docs(text)``: words after a word with a closing mark, or after an empty one that stands for any other; null begins a text."""
    rows = docs.select("text").mapInArrow(_counted, "before string, word string, c long")
    return rows.groupBy("before", "word").agg(F.sum("c").alias("c"))


def _xlogy(x: str, y: str) -> str:
    return f"if({x} = 0, 0D, {x} * ln({y}))"


def log_likelihood(a: str, b: str, ab: str, n: str) -> Column:
    """Dunning's ratio that ``b`` is as frequent after ``a`` as elsewhere; counts of ``a``, ``b``, both and all words."""
    a, b, ab, n = (f"cast({x} as double)" for x in (a, b, ab, n))
    p, p1, p2 = f"({b} / {n})", f"({ab} / {a})", f"(({b} - {ab}) / ({n} - {a}))"
    same = f"{_xlogy(b, p)} + {_xlogy(f'({n} - {b})', f'(1 - {p})')}"
    apart = " + ".join([_xlogy(ab, p1), _xlogy(f"({a} - {ab})", f"(1 - {p1})"), _xlogy(f"({b} - {ab})", p2), _xlogy(f"({n} - {a} - {b} + {ab})", f"(1 - {p2})")])
    return F.expr(f"-2 * ({same} - ({apart}))")


def model_tables(docs: DataFrame, most: int | None = None, tables: list[str] | None = None) -> DataFrame:
    """``(kind, entry, n, score)``: what ``docs(text)`` teaches, all of it; with ``most`` only so many entries of each kind, the most frequent, ties by name.

    ``abbreviation``: types whose final periods, shortness and inner periods say so. ``starter``: types that begin sentences more often than
    chance has it. ``collocation``: a number or a single letter with a period, and the type that belongs after it. ``low``: types after
    closing marks that occur in lower case; ``head``: those of them that are never capitalised within a sentence; ``tail``: types that begin
    sentences in lower case and are never capitalised. ``score`` is null for the last three. Null and empty texts teach nothing.

    Words are counted once, by pairs with a marked word before. The pairs with what is known of their words, and the two aggregates over types that
    follow from them, are tables in the shared folder. Three totals reach the driver. ``tables`` takes the tables' paths, for a caller that deletes them.
    """
    return _learned(docs, most, tables)[1]


def _learned(docs: DataFrame, most: int | None, tables: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """The table of pairs with what is known of their words, and the model."""
    def once(rows: DataFrame, name: str) -> DataFrame:
        rows = written(rows, name)
        if tables is not None:
            tables.append(rows.written_to)
        return rows

    words = described(word_pairs(docs), "word").withColumn("b", F.coalesce("before", F.lit("")))
    spots = once(described(words, "b", "b_").drop("core", "b_core"), "words")
    words = spots.where("type <> ''")
    counts = once(words.groupBy("type").agg(F.sum(F.expr("if(dot, c, 0)")).alias("dotted"), F.sum("c").alias("n")), "counts")
    all_n, all_dots = counts.agg(F.coalesce(F.sum("n"), F.lit(1)), F.coalesce(F.sum("dotted"), F.lit(0))).first()
    share = min(max(all_dots / all_n, 1e-12), 1 - 1e-12)

    letters = F.length(F.regexp_replace("type", "[.]", ""))
    ratio = -2 * (F.col("dotted") * F.log(F.lit(share)) + F.col("plain") * F.log(F.lit(1 - share)) - F.col("dotted") * F.log(F.lit(0.99)) - F.col("plain") * F.log(F.lit(0.01)))
    score = ratio * F.exp(-letters) * (F.length("type") - letters + 1) * F.pow(letters.cast("double"), -F.col("plain").cast("double"))
    marked = counts.where((F.col("dotted") > 0) & (F.col("type") != NUMBER) & F.col("type").rlike(r"\pL")).withColumn("plain", F.col("n") - F.col("dotted"))
    abbreviations = marked.withColumn("score", score).where(F.col("score") >= ABBREVIATION).select("type", F.col("dotted").alias("n"), "score")

    # what stands before each word, now that abbreviations are known
    held = abbreviations.select(F.col("type").alias("b_type"), F.lit(True).alias("b_short"))
    pairs = words.join(held, "b_type", "left")
    ends = F.expr("before is not null and before <> '' and not b_dots and (b_loud or (b_dot and b_short is null))")
    place = F.when(F.col("before").isNull() | ends, "begin").when(F.col("before") == "", "within").otherwise("unknown")
    pairs = pairs.withColumn("place", place).withColumn("ends", ends).withColumn("b_special", F.expr(f"b_letter or b_type = '{NUMBER}'"))

    flag = lambda sql: F.max(F.expr(sql)).alias
    seen = pairs.groupBy("type").agg(
        F.sum(F.expr("if(before <> '', c, 0)")).alias("n"), flag("lower")("lc"), flag("upper")("uc"), flag("upper and place = 'within'")("uc_within"), flag("lower and place = 'begin'")("lc_begin"),
        F.sum(F.expr(r"if(ends and not b_special and type rlike '^\\pL+$', c, 0)")).alias("begins"), F.sum("c").alias("total"), F.sum(F.expr("if(ends, c, 0)")).alias("cut"),
    )
    seen = once(seen, "seen")
    breaks = seen.agg(F.coalesce(F.sum("cut"), F.lit(0))).first()[0]
    begun = seen.where(f"begins > 0 and {all_n} > {breaks}").select("type", F.col("begins").alias("n"), log_likelihood(str(breaks), "total", "begins", str(all_n)).alias("score"), "total")
    starters = begun.where((F.col("score") >= STARTER) & (F.col("n") * F.lit(all_n) > F.col("total") * F.lit(breaks))).drop("total")

    joint = pairs.where("ends and b_special").groupBy("b_type", "type").agg(F.sum("c").alias("n"))
    own = counts.select("type", F.col("n").alias("right"))
    joint = joint.join(own, "type").join(counts.select(F.col("type").alias("b_type"), F.col("n").alias("left")), "b_type").where(f"left > 1 and right > 1 and left < {all_n}")
    joint = joint.withColumn("score", log_likelihood("left", "right", "n", str(all_n))).where((F.col("score") >= COLLOCATION) & (F.lit(all_n) * F.col("n") > F.col("left") * F.col("right")))

    none = F.lit(None).cast("double").alias("score")
    after = seen.where("n > 0")
    kinds = {
        "abbreviation": abbreviations, "starter": starters, "collocation": joint.select(F.concat_ws(" ", "b_type", "type").alias("type"), "n", "score"),
        "low": after.where("lc").select("type", "n", none), "head": after.where("lc and not uc_within").select("type", "n", none), "tail": after.where("lc_begin and not uc").select("type", "n", none),
    }
    out = None
    for kind, rows in kinds.items():
        rows = rows if most is None else rows.orderBy(F.desc("n"), "type").limit(most)
        rows = rows.select(F.lit(kind).alias("kind"), F.col("type").alias("entry"), "n", "score")
        out = rows if out is None else out.unionByName(rows)
    return spots, out


def decided(spots: DataFrame, model: DataFrame) -> DataFrame:
    """``(pair, c, kept)`` of the pairs whose first word has a closing mark that isn't loud: the words with a blank between, and whether the sentence goes on."""
    true = lambda name: F.lit(True).alias(name)
    of = lambda *kinds: F.max(F.col("kind").isin(*kinds)).alias
    short = model.where("kind = 'abbreviation'").select(F.col("entry").alias("b_type"), true("short"))
    right = model.where("kind in ('head', 'starter', 'low', 'tail')").groupBy(F.col("entry").alias("type")).agg(of("head", "starter")("begins"), of("low")("low"), of("tail")("tail"))
    joint = model.where("kind = 'collocation'").select(F.col("entry").alias("both"), true("joint"))
    rows = spots.where("b <> '' and not b_loud").withColumn("pair", F.concat_ws(" ", "b", "word")).join(short, "b_type", "left").na.fill(False, ["short"])
    # after any other word a sentence ends, whatever follows
    asks = f"b_dots or short or b_letter or b_type = '{NUMBER}'"
    plain = rows.where(f"not ({asks})").select("pair", "c", F.lit(False).alias("kept"))
    rows = rows.where(asks).withColumn("both", F.concat_ws(" ", "b_type", "type")).join(right, "type", "left").join(joint, "both", "left").na.fill(False, ["begins", "low", "tail", "joint"])
    kept = f"""case when b_dots or (short and not b_letter) then not (upper and begins)
        when b_letter or b_type = '{NUMBER}' then joint or (lower and not tail) or (b_letter and upper and not low) else false end"""
    return rows.select("pair", "c", F.expr(kept).alias("kept")).unionByName(plain)


def _least(pairs: DataFrame, most: int) -> int:
    """The step of an eighth of a power of two from which on ``pairs(step)`` are ``most`` at most."""
    least, total = 10**6, 0
    for r in pairs.groupBy("step").count().orderBy(F.desc("step")).collect():
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    return least


def _parted(hot, ids: list[str]):
    """Texts with their boundaries as line ends, in parts that end before each pair whose boundary isn't at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, marked, loud = hot.value, _Marked(), _Marked(_SHOUT)
        for batch in batches:
            held: list[tuple] = []
            size = 0

            def out() -> pa.RecordBatch:
                rows, numbers, *texts = zip(*held, strict=True)  # noqa: B023
                columns = [pa.array(numbers, pa.int32()), *[pa.array(x, pa.binary()).cast(pa.string()) for x in texts]]
                return pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(rows)) for c in ids], *columns], [*ids, "_i", "_part", "pair"])  # noqa: B023

            for row, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                words = (text or b"").split()
                if not words:
                    continue
                part, start, number = [], 0, 0
                for end in [i for i, w in enumerate(words[:-1], 1) if marked[w]]:
                    part.append(b" ".join(words[start:end]))
                    start, pair = end, words[end - 1] + b" " + words[end]
                    goes_on = False if loud[words[end - 1]] else kept.get(pair)
                    if goes_on is None:
                        held.append((row, number, b"".join(part), pair))
                        part, number = [], number + 1
                    else:
                        part.append(b" " if goes_on else b"\n")
                part.append(b" ".join(words[start:]))
                # the last part has a pair that is none, so it meets nothing, and such rows are dealt out
                held.append((row, number, b"".join(part), b"\0%d" % row))
                size += len(text)
                if size > OUT:
                    yield out()
                    held, size = [], 0
            if held:
                yield out()
            for seen in (marked, loud):
                if len(seen) > HELD:
                    seen.clear()

    return run


def sentences_of(docs: DataFrame, ids: list[str], held: int = HOT) -> DataFrame:
    """``ids``, ``sent_idx`` and ``sent``: the sentences of ``docs(text)`` by the boundaries that all of them teach; the same as ``train(docs).sentences()``.

    The model stays a table, of any size. Every different pair of words around a closing mark meets it once and is decided, as a table. The most
    frequent pairs, ``held`` at most, go to every task, which splits texts where they are; only at other pairs a text comes apart, and its parts meet the
    pairs in a shuffle before they are put together by the number of their row. The table of pairs stays in the shared folder, as the result reads it.
    """
    spark, tables = docs.sparkSession, []
    try:
        step = F.floor(F.log2(F.col("c").cast("double")) * 8).alias("step")
        pairs = written(decided(*_learned(docs, None, tables)).select("pair", "kept", step), "pairs")
    finally:
        for path in tables:
            delete(spark, path)
    least = _least(pairs, held)
    known = pairs.where(F.col("step") >= least).select("pair", "kept").toArrow()
    hot = spark.sparkContext.broadcast({k.encode(): v for k, v in zip(known["pair"].to_pylist(), known["kept"].to_pylist(), strict=True)})
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), *ids, "text")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema)
    parts = rows.mapInArrow(_parted(hot, ["_row", *ids]), f"{types}, _i int, _part string, pair string")
    met = parts.join(pairs.where(F.col("kept") & (F.col("step") < least)).select("pair", "kept"), "pair", "left")
    texts = met.groupBy("_row", *ids).agg(F.sort_array(F.collect_list(F.struct("_i", "_part", "kept"))).alias("_parts"))
    text = F.expr("filter(split(array_join(transform(_parts, p -> concat(p._part, if(p.kept, ' ', '\\n'))), ''), '\\n'), s -> s <> '')")
    return texts.select(*ids, F.posexplode(text).alias("sent_idx", "sent"))


@dataclass(frozen=True)
class Punkt:
    """What ``model_tables`` found, by kind."""

    abbreviation: frozenset[str] = frozenset()
    starter: frozenset[str] = frozenset()
    collocation: frozenset[str] = frozenset()
    low: frozenset[str] = frozenset()
    head: frozenset[str] = frozenset()
    tail: frozenset[str] = frozenset()

    @classmethod
    def of(cls, rows: Iterable) -> Punkt:
        found: dict[str, set[str]] = {f.name: set() for f in fields(cls)}
        for r in rows:
            found[r["kind"]].add(r["entry"])
        return cls(**{k: frozenset(v) for k, v in found.items()})

    def _in(self, x: str, kind: str) -> str:
        names = sorted(getattr(self, kind))
        return f"{x} in ({', '.join(map(_text, names))})" if names else "false"

    def boundary(self, x: str = "x", y: str = "y") -> str:
        """SQL: whether a sentence ends between the words ``x``, which has a closing mark, and ``y``."""
        upper, lower, letter = f"{y} rlike {_text(UPPER)}", f"{y} rlike {_text(LOWER)}", f"_l rlike {_text(LETTER)}"
        right = lambda body: _let(_of_core(_core(y)), "_r", body)
        begins = right(f"{self._in('_r', 'head')} or {self._in('_r', 'starter')}")
        special = right(f"""case when {self._in("concat(_l, ' ', _r)", "collocation")} then false
            when {lower} and not {self._in("_r", "tail")} then false
            when {letter} and {upper} and not {self._in("_r", "low")} then false else true end""")
        quiet = f"""case when _c rlike {_text('[.][.]$')} or ({self._in("_l", "abbreviation")} and not {letter}) then {upper} and {begins}
          when {letter} or _l = '{NUMBER}' then {special} else true end"""
        return f"case when {x} rlike {_text(LOUD)} then true else {_let(_core(x), '_c', _let(_of_core('_c'), '_l', quiet))} end"

    def sentences(self, text: str = "text") -> Column:
        """The sentences of a column of texts, white space as one blank; null and empty texts have none."""
        return F.expr(self.sentences_sql(text))

    def sentences_sql(self, text: str) -> str:
        """The same as SQL."""
        words = f"split(btrim(regexp_replace(coalesce({text}, ''), {_text(chr(92) + 's+')}, ' ')), ' ')"
        # a function of the words, so that they are made once
        joined = f"transform(array({words}), w -> array_join(transform(w, (x, i) -> concat(x, if(i + 1 < size(w) and x rlike {_text(MARKED)}, if({self.boundary('x', 'w[i + 1]')}, '\\n', ' '), ' '))), ''))[0]"
        return f"filter(transform(split({joined}, '\\n'), s -> btrim(s)), s -> s <> '')"


def train(docs: DataFrame, most: int | None = None) -> Punkt:
    """The model of ``docs(text)`` on the driver, which must hold it; ``sentences_of`` needs no driver for it."""
    tables: list[str] = []
    try:
        return Punkt.of(model_tables(docs, most, tables).collect())
    finally:
        for path in tables:
            delete(docs.sparkSession, path)
