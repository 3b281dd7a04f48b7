"""Quality rules: a threshold table compiled into Spark projections, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent short words of the four languages of the corpus; fixed values.
STOP_WORDS = ("the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "with", "as", "was", "on", "be", "by", "this", "are", "from", "or", "an", "at", "not", "der", "die", "und", "den", "das", "von", "zu", "mit", "ist", "des", "dem", "nicht", "ein", "eine", "als", "auch", "auf", "für", "de", "la", "le", "les", "et", "un", "une", "du", "dans", "que", "est", "pour", "qui", "par", "sur", "au", "avec", "el", "los", "las", "y", "del", "se", "por", "con", "una", "su", "no")

SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    """Keeps a document while ``low * base <= scale * value <= high * base``, in whole numbers; a bound of None does not bind."""

    name: str
    value: str
    base: str
    low: int | None = None
    high: int | None = None
    scale: int = 100

    def sql(self) -> str:
        sides = [f"{self.scale} * {self.value} >= {self.low} * {self.base}" if self.low is not None else None, f"{self.scale} * {self.value} <= {self.high} * {self.base}" if self.high is not None else None]
        return " and ".join(s for s in sides if s)


#: Hundredths of the base. Length, symbol, line and stop-word ratios; wide enough that prose passes.
RULES = (
    Rule("word length", "word_chars", "n_words", low=200, high=1500),
    Rule("symbols per word", "n_symbols", "n_words", high=10),
    Rule("repeated lines", "n_dup_lines", "n_lines", high=50),
    Rule("exclamation words", "n_shouts", "n_words", high=30),
    Rule("stop words", "n_stop", "n_words", low=2),
)

BASE_RULE = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def _length(text: Column) -> Column:
    return F.char_length(text).cast("long")


def _covered(starts: Column, width: int) -> Column:
    """Positions that windows of ``width`` at sorted ``starts`` cover."""
    following = F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0)))
    return F.aggregate(F.zip_with(starts, following, lambda p, q: F.least(F.coalesce(q - p, F.lit(width)), F.lit(width)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def quality_table(docs: DataFrame, rules: tuple[Rule, ...] = RULES, window: int = 8, keep: tuple[str, ...] = ()) -> DataFrame:
    """The measures of each ``docs(doc_id, text)`` row, ``base_failed`` and ``kept``; ``keep`` names other columns to carry.

    Words are runs without \\x20 and \\x09-\\x0D. ``n_repeat_words`` counts words inside windows of eight words that occur twice or more in
    the text (``window`` words, any number from 1 on). Windows are compared by 64-bit hashes, built by doubling: of words, of pairs, of fours, of
    eights; only texts with an equal pair of window hashes go on to the sorted list of starts. Everything is built-in expressions over one row: no shuffle, no Python.

    Null text is as empty: no words, base_failed, not kept. Repeated rows give repeated results. Other columns are ignored.
    """
    if window < 1:
        raise ValueError(f"window {window}")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", *keep, text.alias("_t"))
    rows = rows.select("doc_id", *keep, "_t", F.translate("_t", " \t\n\x0b\x0c\r", "").alias("_c"), F.when(F.col("_t").rlike(r"[^\x20\x09-\x0D]"), F.split(F.regexp_replace("_t", f"^{SPACE}", ""), SPACE)).otherwise(F.array().cast("array<string>")).alias("_raw"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    rows = rows.select(
        "doc_id", *keep,
        _length(F.col("_c")).alias("word_chars"),
        (_length(F.col("_c")) - _length(F.translate("_c", "#*$%&|<>", ""))).alias("n_symbols"),
        lines.alias("_lines"),
        # text that ends in white space leaves one empty string at the end
        F.when(F.get("_raw", F.size("_raw") - 1) == "", F.slice("_raw", F.lit(1), F.greatest(F.size("_raw") - 1, F.lit(0)))).otherwise(F.col("_raw")).alias("_w"),
    )
    rows = rows.select(
        "doc_id", *keep, "word_chars", "n_symbols",
        F.size("_w").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_w", lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
        F.size(F.filter("_w", lambda x: x.endswith("!!"))).cast("long").alias("n_shouts"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h1"),
    )

    def doubled(column: str, by: int) -> Column:
        rest = F.greatest(F.size(column) - by, F.lit(0))
        return F.zip_with(F.slice(column, F.lit(1), rest), F.slice(column, F.lit(by + 1), rest), lambda a, b: F.xxhash64(a, b))

    def appended(column: str, done: int, to: str) -> Column:
        rest = F.greatest(F.size(column) - done, F.lit(0))
        return F.zip_with(F.slice(to, F.lit(1), rest), F.slice(column, F.lit(done + 1), rest), lambda a, b: F.xxhash64(a, b))

    step, width, whole, done = "_h1", 1, None, 0
    while width <= window:
        if window & width:  # the powers of two that the width is a sum of, one after another
            rows = rows.withColumn("_w", F.col(step) if whole is None else appended(step, done, "_w")) if window != width else rows
            whole, done = "_w" if window != width else step, done + width
        if 2 * width <= window:
            rows = rows.withColumn(f"_h{2 * width}", doubled(step, width)).drop(step)
            step = f"_h{2 * width}"
        width *= 2
    rows = rows.withColumnRenamed(whole, "_h").drop(step)
    step = "_h"
    pairs = F.sort_array(F.transform(step, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_s", F.when(F.size(F.array_distinct(step)) < F.size(step), pairs)).drop(step)
    size = F.size("_s")
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice("_s", F.lit(1), size - 1))
    after = F.slice("_s", F.lit(2), size - 1)
    marked = F.zip_with(F.zip_with("_s", before, lambda x, y: F.struct(x["h"].alias("h"), x["i"].alias("i"), F.coalesce(x["h"] == y["h"], F.lit(False)).alias("e"))), after, lambda x, y: F.when(x["e"] | F.coalesce(x["h"] == y["h"], F.lit(False)), x["i"]))
    rows = rows.withColumn("_p", F.when(size > 0, F.sort_array(F.array_compact(marked)))).drop("_s")
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.when(F.size("_p") > 0, _covered(F.col("_p"), window)), F.lit(0).cast("long"))).drop("_p")
    verdict = " and ".join(f"({r.sql()})" for r in rules) or "true"
    rows = rows.withColumn("base_failed", F.expr(BASE_RULE))
    return rows.withColumn("kept", ~F.col("base_failed") & F.expr(verdict))


def quality_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same measures and verdict as DuckDB SQL over ``documents``."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    verdict = " and ".join(f"({r.sql()})" for r in rules) or "true"
    return f"""
with base as (select doc_id, coalesce(text, '') as t from documents),
split as (select doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from base),
hits as (select doc_id, n from (select doc_id, list_aggregate(w[i:i+7], 'string_agg', ' ') as g, i from split, unnest(range(1, len(w) - 6)) as u(i)) s
  join (select doc_id, g from (select doc_id, list_aggregate(w[i:i+7], 'string_agg', ' ') as g from split, unnest(range(1, len(w) - 6)) as u(i)) group by all having count(*) > 1) r using (doc_id, g), unnest(range(i, i + 8)) as v(n)),
repeats as (select doc_id, count(distinct n) as n_repeat_words from hits group by doc_id),
measured as (select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines,
  len(list_filter(w, lambda x: lower(x) in ({stop}))) as n_stop, len(list_filter(w, lambda x: ends_with(x, '!!'))) as n_shouts,
  coalesce(n_repeat_words, 0) as n_repeat_words from split left join repeats using (doc_id)),
failed as (select *, ({BASE_RULE}) as base_failed from measured)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, n_lines::bigint as n_lines, n_stop::bigint as n_stop, n_shouts::bigint as n_shouts, base_failed, (not base_failed and {verdict}) as kept from failed"""


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the table keeps, with all their columns, whatever they are called; a row for each repeated row, null ids included.

    Null and empty texts go, as does every text of fewer than 20 words; an empty table gives an empty one.

    The verdict is combined with an expression that isn't deterministic: otherwise the filter is pushed below the projections and each
    measure is computed again for every place that it is mentioned in.
    """
    judged = quality_table(docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row")), rules, keep=("_row",))
    return judged.select("_row", (F.col("kept") & (F.monotonically_increasing_id() >= 0)).alias("_kept")).where("_kept").select("_row.*")
