"""Readers of the file formats of the data model: tagged articles, topics, rank lists, parallel lines, stories, JSON lines, matrices."""

from __future__ import annotations

import io
import json
import struct

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexisift.functions import text as T

SCORED_SENTENCE = "sid string, sentence string, rouge_1_recall double, rouge_2_recall double, rouge_1_f1 double, rouge_2_f1 double"
MASKED_QUERY = "cid string, raw_query array<string>, masked_query array<string>, masked_query_with_sub string"
OPEN_IE = "cid string, raw_summary string, open_ie array<struct<words: array<string>, verbs: array<struct<tags: array<string>>>, raw_sentence: string>>"
RETRIEVAL_RANK = "doc_id string, rank_ids array<string>"
CLUSTER_SENTENCES = "sid string, sentence string, masked_summary array<string>, masked_summary_with_sub string"
RANKED_SENTENCES = "doc_id string, sentences array<struct<sid: string, sentence: string, score: double>>"
TRAINING = SCORED_SENTENCE + ", masked_summary array<string>"
PASSAGE = "cid string, pid string, text string"
SAMPLE_CLUSTER = "cluster_id string, cluster_docs array<array<string>>, cluster_summaries array<string>, cluster_sample_ids array<string>"


def _file_name() -> Column:
    return F.element_at(F.split(F.input_file_name(), "/"), -1)


def articles(spark: SparkSession, path: str) -> DataFrame:
    """``(did, text, paragraphs)`` of tagged articles: the TEXT element, else GRAPHIC; its P elements, else blocks between blank lines."""
    raw = spark.read.text(path, wholetext=True).select(_file_name().alias("did"), F.col("value").alias("raw"))
    return raw.select("did", T.article_body(F.col("raw")).alias("text")).withColumn("paragraphs", T.paragraphs(F.col("text")))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, line)``: lines of files with their number, blank lines included.

    Files are read in splits, so a large one is many tasks. A line's number is its place among the lines of its split and the number of lines
    of the splits before it; only a count for each split is sorted within a file. Files of one name in several folders are numbered apart.
    """
    lines = spark.read.text(path).select(_file_name().alias("file"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_split"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("_at"))
    firsts = lines.groupBy("_path", "_split").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_path").orderBy("_split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = firsts.select("_path", "_split", "_first", before.alias("_before"))
    return lines.join(firsts, ["_path", "_split"]).select("file", (F.col("_at") - F.col("_first") + F.col("_before")).cast("long").alias("line_no"), "line")


def topics(spark: SparkSession, path: str) -> DataFrame:
    """``(file, seq, num, title, narr)``: segments between three line breaks, up to the first one without a number."""
    raw = spark.read.text(path, wholetext=True).select(_file_name().alias("file"), F.split("value", "\n\n\n").alias("s"))
    tag = lambda x, t: F.trim(F.regexp_extract(x, rf"<{t}>\s*([\s\S]*?)\s*</{t}>", 1))
    found = raw.select("file", F.transform("s", lambda x: F.struct(tag(x, "num").alias("num"), tag(x, "title").alias("title"), tag(x, "narr").alias("narr"))).alias("s"))
    whole = F.aggregate("s", F.lit(0), lambda n, x: F.when((n < 0) | (x["num"] == ""), F.when(n < 0, n).otherwise(-n - 1)).otherwise(n + 1))
    found = found.withColumn("n", whole).withColumn("n", F.when(F.col("n") < 0, -F.col("n") - 1).otherwise(F.col("n")))
    return found.select("file", F.posexplode(F.expr("slice(s, 1, n)")).alias("seq", "t")).select("file", "seq", "t.*")


def parallel(spark: SparkSession, source: str, target: str) -> DataFrame:
    """``(line_no, stories, summary)``: source and target lines by number; stories between five pipes; the target's two leading characters go."""
    left, right = numbered_lines(spark, source), numbered_lines(spark, target)
    joined = left.select("line_no", F.col("line").alias("src")).join(right.select("line_no", F.col("line").alias("tgt")), "line_no").where("src <> ''")
    return joined.select("line_no", F.split("src", r"\|\|\|\|\|").alias("stories"), F.expr("substring(tgt, 3)").alias("summary"))


def stories(spark: SparkSession, first: str, second: str) -> DataFrame:
    """``(did, article, highlights)`` of story files; a file of the first folder wins over one of the same name in the second."""
    both = numbered_lines(spark, first).withColumn("p", F.lit(0)).unionByName(numbered_lines(spark, second).withColumn("p", F.lit(1)))
    lines = both.groupBy("file").agg(F.min("p").alias("p")).join(both, ["file", "p"]).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("line_no", F.trim("line").alias("line")))).alias("l"))
    text = F.filter(F.transform("l", lambda x: T.missing_period(x["line"])), lambda x: x != "")
    at = F.array_position(F.transform(text, lambda x: x.startswith("@highlight").cast("int")), 1)
    body = F.when(at > 0, F.slice(text, F.lit(1), (at - 1).cast("int"))).otherwise(text)
    rest = F.when(at > 0, F.filter(F.slice(text, at.cast("int"), F.size(text)), lambda x: ~x.startswith("@highlight"))).otherwise(F.array().cast("array<string>"))
    return lines.select(F.regexp_replace("file", r"\.story$", "").alias("did"), body.alias("article"), rest.alias("highlights"))


def rank_lists(spark: SparkSession, path: str) -> DataFrame:
    """``(cid, rank, sid, score, sent)`` of rank files; a line's number is its rank, the last field the sentence."""
    f = F.split("line", "\t")
    return numbered_lines(spark, path).where("line <> ''").select(F.col("file").alias("cid"), (F.col("line_no") + 1).alias("rank"), f[0].alias("sid"), F.when(F.size(f) > 2, f[1].try_cast("double")).alias("score"), F.element_at(f, -1).alias("sent"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under one of the schemas of this module; blank lines are ignored."""
    return spark.read.schema(schema).json(path)


def topic_queries(spark: SparkSession, path: str) -> DataFrame:
    """``(cid, domain, query)`` of a file with tabs."""
    return spark.read.csv(path, sep="\t", schema="cid string, domain string, query string", quote="")


def tagged_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(file, sent_idx, words)``: between sentence marks, the first field of each line."""
    found = F.regexp_extract_all("value", F.lit(r"#s-sent\n([\s\S]*?)\n#e-sent"), 1)
    raw = spark.read.text(path, wholetext=True).select(_file_name().alias("file"), F.posexplode(found).alias("sent_idx", "s"))
    return raw.select("file", "sent_idx", F.transform(F.split("s", "\n"), lambda x: F.split(x, "\t")[0]).alias("words"))


def file_names(spark: SparkSession, path: str) -> DataFrame:
    """``(folder, name)`` of the files below a folder, as clusters and their documents lie there; contents aren't read, ``.swp`` files are left out."""
    parts = F.split("path", "/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name")).where(~F.col("name").endswith(".swp"))


def reference_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(prefix, file, text)`` of reference files; what stands before the first point of a name is the prefix of its clusters' ids."""
    raw = spark.read.text(path, wholetext=True).select(_file_name().alias("file"), F.col("value").alias("text"))
    return raw.select(F.split_part("file", F.lit("."), F.lit(1)).alias("prefix"), "file", "text")


def label_lines(spark: SparkSession, path: str, n_labels: int) -> DataFrame:
    """``(file, sent_idx, labels)``: a line a sentence, its label numbers joined by ``_``, as a vector of ones and zeros."""
    lines = numbered_lines(spark, path).where("line <> ''")
    found = F.split("line", "_")
    hot = F.transform(F.sequence(F.lit(0), F.lit(n_labels - 1)), lambda i: F.array_contains(found, i.cast("string")).cast("int"))
    return lines.select("file", F.col("line_no").alias("sent_idx"), hot.alias("labels"))


def decoded(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """``(cid, text)``: line i of a decoder's output belongs to cluster i of ``ids(line_no, cid)``."""
    return numbered_lines(spark, path).select("line_no", F.col("line").alias("text")).join(ids, "line_no").select("cid", "text")


def masked_summaries(spark: SparkSession, path: str, key: str = "masked_seq") -> DataFrame:
    """``(cid, masked_summary)`` of JSON lines that are known by their number only: line i is cluster i."""
    lines = numbered_lines(spark, path).where("line <> ''")
    return lines.select(F.col("line_no").cast("string").alias("cid"), F.from_json("line", f"struct<{key}: array<string>>")[key].alias("masked_summary"))


def cluster_rows(spark: SparkSession, path: str) -> DataFrame:
    """``(cid, masked_summary, sents)`` of a file of scored sentences a cluster: the mask of its first row, and its sentences in their order."""
    rows = numbered_lines(spark, path).where("line <> ''").select(F.regexp_replace("file", r"\.[^.]*$", "").alias("cid"), "line_no", F.from_json("line", f"struct<{CLUSTER_SENTENCES.replace(' ', ': ').replace(',: ', ', ')}>").alias("r"))
    own = F.sort_array(F.collect_list(F.struct("line_no", "r.sid", "r.sentence")))
    return rows.groupBy("cid").agg(F.min_by("r.masked_summary", "line_no").alias("masked_summary"), F.transform(own, lambda x: F.struct(x["sid"].alias("sid"), x["sentence"].alias("sentence"))).alias("sents"))


def examples(spark: SparkSession, path: str, c: float = 0.15) -> DataFrame:
    """``(guid, text_a, text_b, label)`` of training lines: the masked summary, the sentence, and its smoothed label."""
    rows = json_lines(spark, path, TRAINING)
    return rows.select(F.col("sid").alias("guid"), F.array_join("masked_summary", " ").alias("text_a"), F.col("sentence").alias("text_b"), T.smoothed_label(F.col("rouge_1_f1"), F.col("rouge_2_f1"), c).alias("label"))


def passages(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """``(cid, pid, text)`` of JSON lines of passages: all, or those of ``ids(cid, pid)``."""
    rows = json_lines(spark, path, PASSAGE)
    return rows if ids is None else rows.join(ids.select("cid", "pid").distinct(), ["cid", "pid"], "left_semi")


def oracle_queries(references: DataFrame, ref_idx: int = 1) -> DataFrame:
    """``(cid, query)``: one reference of each cluster, its lines put together, in the place of a query."""
    return references.where(F.col("ref_idx") == ref_idx).select("cid", F.regexp_replace("text", "\n", "").alias("query"))


def separated(spark: SparkSession, path: str, schema: str, quote: str = '"') -> DataFrame:
    """Fields between tabs, quoted or not, under a schema; a byte order mark at the start of a file isn't part of its first field."""
    rows = spark.read.csv(path, sep="\t", schema=schema, quote=quote)
    return rows.withColumn(rows.columns[0], F.regexp_replace(rows.columns[0], "^\ufeff", "").cast(rows.schema[0].dataType))


def matrices(spark: SparkSession, path: str) -> DataFrame:
    """``(file, i, row)`` of ``.npy`` files of one or two dimensions, a row each; a vector is one row a number. A file is read whole by one task."""

    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                m = np.load(io.BytesIO(content.as_buffer().to_pybytes()), allow_pickle=False)
                m = m.astype(float).reshape(len(m), -1)
                for at in range(0, len(m), 1000):
                    part = m[at : at + 1000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(at, at + len(part)), pa.int64()), pa.array(part.tolist(), pa.list_(pa.float64()))], ["file", "i", "row"])

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.mapInArrow(read, "file string, i long, row array<double>")


def length_prefixed(spark: SparkSession, path: str) -> DataFrame:
    """``(file, i, record)`` of binary files of records with their length in eight bytes, little-endian, in front; a cut record is an error."""

    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, at, out = memoryview(content.as_buffer()), 0, []
                while at < len(data):
                    size = struct.unpack_from("<q", data, at)[0]
                    if size < 0 or at + 8 + size > len(data):
                        raise ValueError(f"record at byte {at} of {name} is cut")
                    out.append(bytes(data[at + 8 : at + 8 + size]))
                    at += 8 + size
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(out), pa.string()), pa.array(range(len(out)), pa.int64()), pa.array(out, pa.binary())], ["file", "i", "record"])

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.mapInArrow(read, "file string, i long, record binary")


def result_table(spark: SparkSession, path: str) -> DataFrame:
    """``(system, n, kind, value)`` of a scorer's printed averages, lines such as ``1 ROUGE-2 Average_R: 0.08123 (95%-conf.int. ...)``."""
    pattern = r"^(\S+) ROUGE-(\S+) Average_([RPF]): ([0-9.]+)"
    part = lambda k: F.regexp_extract("value", pattern, k)
    kinds = F.create_map(*[F.lit(x) for pair in (("R", "recall"), ("P", "precision"), ("F", "f1")) for x in pair])
    return spark.read.text(path).where(F.col("value").rlike(pattern)).select(part(1).alias("system"), part(2).alias("n"), kinds[part(3)].alias("kind"), part(4).cast("double").alias("value"))


def settings(path: str) -> dict[str, dict]:
    """Sections of a settings file in JSON, read on the driver; a value that isn't a section is an error."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    if not isinstance(found, dict) or not all(isinstance(v, dict) for v in found.values()):
        raise ValueError("settings are sections of names and values")
    return found


def topics_of_years(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """``topics`` of several years, one after another, with their ``year``."""
    parts = [topics(spark, path).withColumn("year", F.lit(year)) for year, path in sorted(paths.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def manual_references(spark: SparkSession, path: str, words: int = 250) -> DataFrame:
    """``reference_texts`` of files that people wrote: names of a cluster, ``M``, the length and two marks of the writer."""
    return reference_texts(spark, path).where(F.col("file").rlike(rf"^\S+\.M\.{words}\.\D\.\D$"))


def counted(rows: DataFrame, expected: int) -> DataFrame:
    """The rows, if there are as many as expected; an error names both numbers otherwise."""
    found = rows.count()
    if found != expected:
        raise ValueError(f"{found} rows instead of {expected}")
    return rows
