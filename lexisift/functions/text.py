"""Scalar functions over text and arrays, as columns: no Python runs on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexisift.functions.stem import stemmed

#: Word lists of the query masker; fixed values, replaced in this order.
WH_WORDS = ("what", "where", "why", "when", "who", "which", "how", "whom")
BINARY_VERBS = ("is", "are", "have", "do")
COMMANDS = ("describe", "identify", "explain", "name", "report", "include", "provide", "discuss", "note", "specify", "give", "determine", "summarize", "track", "relate", "write")
MASK, SUBQUERY = "[MASK]", "[SUBQUERY]"
#: A word of any script: letters and numbers.
WORD = r"[\pL\pN]+"


def one_space(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def split_sentences(text: Column) -> Column:
    """Sentences between a closing mark with a space after it and the next word; blanks dropped."""
    return F.filter(F.split(F.regexp_replace(one_space(text), r"([.!?]) +", "$1\n"), "\n"), lambda x: x != "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def article_body(raw: Column) -> Column:
    """The TEXT element of a tagged article, else its GRAPHIC element, else null."""
    found = [F.regexp_extract(raw, rf"<{t}>\s*([\s\S]*?)\s*</{t}>", 1) for t in ("TEXT", "GRAPHIC")]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found])


def paragraphs(text: Column) -> Column:
    tagged = F.regexp_extract_all(text, F.lit(r"<P>\s*([\s\S]*?)\s*</P>"), 1)
    return F.filter(F.when(F.size(tagged) > 0, tagged).otherwise(F.split(text, "\n\n")), lambda x: F.btrim(x) != "")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, with the value made once however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def normal_sentence(sent: Column, stop_words: tuple[str, ...] = (), min_words: int = 0, drop_dialogue: bool = False, quoted_speech: bool = False, stem: bool = False) -> Column:
    """Lower case, one space, null if empty, short or dialogue; then without stop words, duplicates and order kept; then stemmed, if asked."""

    def kept(low: Column) -> Column:
        keep = low != ""
        if min_words:
            keep = keep & (F.size(tokens(low)) >= min_words)
        if drop_dialogue:
            keep = keep & ~low.contains("''") & ~low.contains("``")
        if quoted_speech:
            keep = keep & ~(low.startswith("'") & (low.contains("says") | low.contains("said")))
        return F.when(keep, low)

    low = bound(one_space(F.lower(sent)), kept)
    if stop_words:
        low = bound(F.array_join(F.filter(F.split(low, " "), lambda x: ~x.isin(*stop_words)), " "), lambda x: F.when(x != "", x))
    if stem:
        low = F.nullif(F.array_join(stemmed(F.split(low, " ")), " "), F.lit(""))
    return low


def processed_paragraph(sentences: Column, **options) -> Column:
    """``(sent, proc)`` of the sentences of a paragraph whose processed form isn't empty; native options only."""
    both = F.transform(sentences, lambda s: F.struct(s.alias("sent"), normal_sentence(s, **options).alias("proc")))
    return F.filter(both, lambda x: x["proc"].isNotNull())


def ngrams(words: Column, n: int) -> Column:
    """The n-grams of a token array, joined by spaces; none if it is shorter than n. ``words`` should be a column: it is read for each of them."""
    if n == 1:
        return words
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + k) for k in range(1, n)]))


def mask_question(text: Column) -> Column:
    """Wh-words as masks, anywhere in a word; a binary verb at the start as a mask, wherever it occurs; without either, command words before a space."""
    low = F.lower(F.replace(text, F.lit("?"), F.lit(".")))
    out = low
    for w in WH_WORDS:
        out = F.replace(out, F.lit(w), F.lit(MASK))
    for w in BINARY_VERBS:
        out = F.when(out.startswith(w), F.replace(out, F.lit(w), F.lit(MASK))).otherwise(out)
    command = low
    for w in COMMANDS:
        command = F.replace(command, F.lit(f"{w} "), F.lit(f"{MASK} "))
    return F.when(out != low, out).otherwise(command)


def join_subqueries(sentences: Column) -> Column:
    return F.array_join(F.transform(sentences, lambda x: F.regexp_replace(x, r"\.$", "")), f" {SUBQUERY} ")


def decorate(query: Column, kind: Column, prediction: Column | None = None) -> Column:
    """A query as it is, between masks, after a mask, and so on; an unknown kind is an error."""
    m = F.lit(MASK)
    out = F.when(kind == "plain", query).when(kind == "both", F.concat_ws(" ", m, query, m)).when(kind == "lead", F.concat_ws(" ", m, query)).when(kind == "stop", F.concat_ws(" ", m, query, F.lit(".")))
    if prediction is not None:
        out = out.when(kind == "expanded", F.concat_ws(" ", m, query, F.lit("."), prediction))
    return out.otherwise(F.raise_error(F.concat(F.lit("no kind of query: "), kind)))


def placeholder(sentences: Column) -> Column:
    return F.array_join(F.array_repeat(F.lit(f"{MASK} ."), sentences), " ")


def length_token(words: Column) -> Column:
    """Buckets of 15 words from 100 to 400; 85 under that."""
    bucket = F.when(words < 100, 85).when(words >= 400, 400).otherwise(100 + F.floor((words - 100) / 15) * 15)
    return F.concat(F.lit("[unused"), bucket.cast("string"), F.lit("]"))


def missing_period(line: Column) -> Column:
    return F.when((line == "") | line.startswith("@highlight") | line.rlike(r"""[.!?…'`")’”]$"""), line).otherwise(F.concat(line, F.lit(" .")))


def letter_period(text: Column) -> Column:
    return F.when(text.rlike(r"\p{L}$"), F.concat(text, F.lit("."))).otherwise(text)


def title_text(title: Column, narrative: Column) -> Column:
    """``describe`` the title, then the narrative, with one full stop between."""
    head = F.concat(F.lit("describe "), F.btrim(title))
    return F.concat(head, F.when(head.endswith("."), " ").otherwise(". "), narrative)


def detokenised(text: Column) -> Column:
    """Clitics, ellipses, numbers and initials closed up again, in tokens between single spaces."""
    out = one_space(text)
    for pattern, by in (
        (r"n ' t(?= |$)", " n't"),
        (r"(^| )' (s|d|ll)(?= |$)", "$1'$2"),
        (r"(^| )\. \. \.(?= |$)", "$1..."),
        (r"(?<=[0-9]) , (?=[0-9])", ","),
        (r"(?<=[0-9]) \. (?=[0-9])", "."),
        (r"(?<=\b[A-Z]) \. (?=[A-Z] \.)", "."),
        (r"(?<=\.[A-Z]) \.", "."),
    ):
        out = F.regexp_replace(out, pattern, by)
    return one_space(out)


def clean_line(text: Column) -> Column:
    return F.replace(F.btrim(F.btrim(text), F.lit("-")), F.lit("---"), F.lit(""))


def without_newline_marks(text: Column) -> Column:
    return F.btrim(F.replace(text, F.lit("NEWLINE_CHAR"), F.lit("")))


def raw_query(parts: Column, kind: str) -> Column:
    """Of a query's parts the TITLE (the first, with a full stop), the NARR (the others) or the whole QUERY; another kind is an error."""
    title = F.concat(F.btrim(parts[0]), F.lit("."))
    narrative = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), " ")
    return {"TITLE": title, "NARR": narrative, "QUERY": F.concat_ws(" ", title, F.nullif(narrative, F.lit("")))}[kind]


def merge_masks(words: Column, base: str | None = None) -> Column:
    """Adjacent masks as one. With a ``base`` token, it is dropped first, and a sentence of nothing but masks is empty."""
    if base is not None:
        left = F.filter(words, lambda w: w != base)
        return F.when(F.exists(left, lambda w: w != MASK), merge_masks(left)).otherwise(F.array().cast("array<string>"))
    before = F.concat(F.array(F.lit("")), F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))
    return F.array_compact(F.zip_with(words, before, lambda w, p: F.when((w != MASK) | (p != MASK), w)))


def pair_lengths(a: Column, b: Column, most: int) -> tuple[Column, Column]:
    """Lengths of two lists cut, longest first and the second on ties, to ``most`` in all."""
    keep_a = F.when(a + b <= most, a).otherwise(F.least(a, F.greatest(most - b, F.lit((most + 1) // 2))))
    return keep_a, F.least(b, most - keep_a)


def pair_features(a: Column, b: Column, most: int) -> dict[str, Column]:
    """``[CLS] a [SEP] b [SEP]`` with segments and mask, filled up to ``most``."""
    tokens_ = F.concat(F.array(F.lit("[CLS]")), a, F.array(F.lit("[SEP]")), b, F.array(F.lit("[SEP]")))
    fill = F.greatest(F.lit(0), most - F.size(tokens_))
    ones, zeros = F.size(b) + 1, F.size(a) + 2
    return {
        "tokens": F.concat(tokens_, F.array_repeat(F.lit("[PAD]"), fill)),
        "segments": F.concat(F.array_repeat(F.lit(0), zeros), F.array_repeat(F.lit(1), ones), F.array_repeat(F.lit(0), fill)),
        "mask": F.concat(F.array_repeat(F.lit(1), F.size(tokens_)), F.array_repeat(F.lit(0), fill)),
    }


def single_features(words: Column, most: int) -> dict[str, Column]:
    """``[CLS] words`` of a query or paragraph by itself, cut and filled up to ``most``; one segment."""
    tokens_ = F.slice(F.concat(F.array(F.lit("[CLS]")), words), 1, most)
    fill = most - F.size(tokens_)
    return {"tokens": F.concat(tokens_, F.array_repeat(F.lit("[PAD]"), fill)), "segments": F.array_repeat(F.lit(0), most), "mask": filled_mask(F.size(tokens_), most)}


def span_masks(lengths: Column, rows: int, most: int, offset: int = 1) -> Column:
    """For each of ``rows`` sentences ones at its words in a packed paragraph that begins after ``offset`` tokens, zeros elsewhere."""
    ends = F.transform(lengths, lambda n, i: F.aggregate(F.slice(lengths, F.lit(1), i + 1), F.lit(0), lambda s, x: s + x))
    spans = F.transform(F.slice(ends, 1, rows), lambda end, i: F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: ((k >= end - lengths[i] + offset) & (k < end + offset)).cast("int")))
    return F.concat(spans, F.array_repeat(F.array_repeat(F.lit(0), most), F.greatest(F.lit(0), rows - F.size(lengths))))


def filled_mask(n: Column, most: int) -> Column:
    return F.concat(F.array_repeat(F.lit(1), F.least(n, F.lit(most))), F.array_repeat(F.lit(0), F.greatest(most - n, F.lit(0))))


def smoothed_label(rouge_1: Column, rouge_2: Column, c: float = 0.15) -> Column:
    return (1 - c) * rouge_2 + c * rouge_1


def sid(doc: Column, sent: Column) -> Column:
    return F.concat_ws("_", doc.cast("string"), sent.cast("string"))


def sid_part(sid_: Column, k: int) -> Column:
    return F.split_part(sid_, F.lit("_"), F.lit(k)).cast("long")


def clipped(words: Column, most: int) -> Column:
    return F.slice(words, 1, most)


def subquery_tokens(words: Column, token: str, most: int) -> Column:
    """Sub-query marks as ``token``, cut to ``most - 1`` words, and one token at the end."""
    return F.array_append(clipped(F.transform(words, lambda w: F.when(w == SUBQUERY, token).otherwise(w)), most - 1), F.lit(token))


def tagged_abstract(sentences: Column) -> Column:
    return F.array_join(F.transform(sentences, lambda x: F.concat(F.lit("<s> "), x, F.lit(" </s>"))), " ")


def first_field(line: Column) -> Column:
    return F.split_part(line, F.lit("\t"), F.lit(1))


def is_number(word: Column) -> Column:
    """Digits and commas only."""
    return word.rlike("^[0-9,]+$")


def label_vector(labels: Column) -> Column:
    """Labels as doubles, -1 as 0."""
    return F.transform(labels, lambda x: F.when(x == -1, F.lit(0.0)).otherwise(x.cast("double")))


def reversed_labels(labels: Column) -> Column:
    return F.transform(labels, lambda x: 1 - x)


def percent(share: Column) -> Column:
    return F.format_string("%.2f", F.round(share.cast("double") * 100, 2))


def ragged_mask(lengths: Column, rows: int, most: int) -> Column:
    """A row of ones and zeros for each length, cut and filled up to ``rows`` rows of ``most``."""
    each = F.transform(F.slice(lengths, 1, rows), lambda n: filled_mask(n, most))
    return F.concat(each, F.array_repeat(F.array_repeat(F.lit(0), most), F.greatest(F.lit(0), rows - F.size(lengths))))
