"""The library for SQL: scalar functions and a table function that Spark inlines, so that they are optimised like expressions."""

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexisift.functions import stem as S
from lexisift.functions.punkt import Punkt

#: Name, parameters, result and body of each function.
_SPACED = r"btrim(regexp_replace(t, '\\s+', ' '))"
SCALARS = (
    ("split_sentences", "t string", "array<string>", rf"filter(split(regexp_replace({_SPACED}, '([.!?]) +', '$1\n'), '\n'), x -> x <> '')"),
    ("word_tokens", "t string", "array<string>", r"regexp_extract_all(lower(t), '[\\pL\\pN]+', 0)"),
    ("n_words", "t string", "int", "size(word_tokens(t))"),
    ("word_ngrams", "t string, n int", "array<string>", "array_distinct(transform(sequence(1, greatest(size(word_tokens(t)) - n + 1, 0)), i -> array_join(slice(word_tokens(t), i, n), ' ')))"),
    ("overlap_count", "t string, query string", "bigint", "cast(aggregate(transform(word_tokens(t), w -> size(filter(word_tokens(query), q -> q = w))), 0, (a, x) -> a + x) as bigint)"),
    ("sentence_id", "doc_id bigint, sent_idx bigint", "string", "concat(doc_id, '_', sent_idx)"),
    ("smoothed_label", "rouge1 double, rouge2 double", "double", "0.85D * rouge2 + 0.15D * rouge1"),
    ("length_token", "n int", "string", "concat('[unused', case when n < 100 then 85 when n >= 400 then 400 else 100 + (n - 100) div 15 * 15 end, ']')"),
)


def register(spark: SparkSession, model: Punkt | None = None) -> list[str]:
    """Makes the functions known to ``spark.sql`` and returns their names; ``split_sentences`` and ``explode_sentences`` take a model, if given.

    ``explode_sentences(text)`` is a table function with the columns ``sent_idx`` and ``sent``: ``select ... from docs, lateral
    explode_sentences(text)``. All but ``porter_stem`` are SQL functions, which Spark replaces by their bodies; a null text has no rows.
    """
    for name, parameters, result, body in SCALARS:
        if name == "split_sentences":
            body = sentences = model.sentences_sql("t") if model else body
        if name == "word_ngrams":
            body = f"if(size(word_tokens(t)) < n or t is null, array(), {body})"
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {result} return {body}")
    # a generator takes expressions, not SQL functions
    spark.sql(f"create or replace temporary function explode_sentences(t string) returns table (sent_idx int, sent string) return select pos, col from posexplode({sentences})")

    def stems(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else S.stem(w))

    spark.udf.register("porter_stem", F.pandas_udf(stems, StringType()))
    return [s[0] for s in SCALARS] + ["explode_sentences", "porter_stem"]
