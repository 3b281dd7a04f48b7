"""The operators as named queries over the tables of a folder, each with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexisift.functions import text as T
from lexisift.operators import assemble, mask, metrics, rank, rouge, score, select
from lexisift.session import importable
from lexisift.sources import tables
from lexisift.sources.tables import documents, references, sentences, table
from lexisift.sources.tables import queries as cluster_queries

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return f(spark, sf_dir)

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Relations in SQL that several queries share.
_DOCS = "docs as (select source as cid, doc_id, text from documents)"
_SENTS = _DOCS + r""", lists as (select cid, doc_id, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) +', '\1' || chr(10), 'g'), chr(10)), lambda x: x <> '') as l from docs),
sents as (select cid, doc_id, i - 1 as sent_idx, l[i] as sent from lists, unnest(range(1, len(l) + 1)) as u(i))"""
_TERMS = _SENTS + ", terms as (select cid, doc_id, sent_idx, term, count(*) as tf from (select cid, doc_id, sent_idx, unnest(regexp_extract_all(lower(sent), '[\\pL\\pN]+')) as term from sents) group by all)"
_REFS = "refs as (select 'src' || (item_id % 20) as cid, item_id, item_id // 20 as ref_idx, text from benchmark)"
_QS = _REFS + ", qs as (select cid, min_by(text, item_id) as query from refs group by cid), qt as (select cid, term, count(*) as qtf from (select cid, unnest(regexp_extract_all(lower(query), '[\\pL\\pN]+')) as term from qs) group by all)"
_REL = f"with {_TERMS}, {_QS}, sizes as (select cid, sum(qtf) as qlen, sum(qtf * qtf) as qsq from qt group by cid), lens as (select cid, doc_id, sent_idx, sum(tf) as slen, sum(tf * tf) as ssq from terms group by all), shared as (select cid, doc_id, sent_idx, sum(tf * qtf) as dot, sum(sqrt((tf * qtf)::double)) as root from terms join qt using (cid, term) group by all), rel as (select cid, doc_id, sent_idx, qlen, qsq, coalesce(dot, 0) as dot, coalesce(root, 0) as root, coalesce(slen, 0) as slen, coalesce(ssq, 0) as ssq from sents join sizes using (cid) left join lens using (cid, doc_id, sent_idx) left join shared using (cid, doc_id, sent_idx))"
_COUNT = f"with {_TERMS}, {_QS}, every as (select cid, doc_id, sent_idx, coalesce(sum(tf * qtf), 0)::bigint as score from sents join qs using (cid) left join terms using (cid, doc_id, sent_idx) left join qt using (cid, term) group by all), scores as (select * from every where score > 0)"
_RANKED = _COUNT + ", ranks as (select *, row_number() over (partition by cid order by score desc, doc_id, sent_idx) as rank from scores)"
_HEAD = _RANKED.removeprefix("with ") + ", head as (select cid, doc_id, sent, rank - 1 as i from ranks join sents using (cid, doc_id, sent_idx) where rank <= 90)"
_EVENTS = "ranks as (select user_id, event_id, value, (round(value * 100))::bigint as cents, row_number() over (partition by user_id order by value desc, event_id) as rank from events where value is not null)"


def _sents(spark: SparkSession, d: str) -> DataFrame:
    return sentences(documents(spark, d))


def _events(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where("value is not null").select("user_id", "event_id", "value", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return rank.ranked(rows, "user_id", "event_id", score="value")


def _counts(spark: SparkSession, d: str) -> DataFrame:
    """Overlap counts as retrieval takes them: sentences that share nothing with their query are pruned."""
    return rank.pruned(score.overlaps(_sents(spark, d), cluster_queries(spark, d)))


def _top(spark: SparkSession, d: str, k: int = 90) -> DataFrame:
    """Retrieved sentences of each cluster with their words: the bounded input of extraction."""
    best = rank.top_k(_counts(spark, d), k, "cid", "doc_id", "sent_idx")
    # only documents that a retrieved sentence comes from are split again
    docs = documents(spark, d).join(best.select("cid", "doc_id").distinct(), ["cid", "doc_id"], "left_semi")
    return best.join(sentences(docs), ["cid", "doc_id", "sent_idx"]).withColumn("words", T.tokens(F.col("sent")))


def _head(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of a cluster's graph: its 90 best sentences, numbered by rank from 0."""
    return _top(spark, d).withColumn("i", (F.col("rank") - 1).cast("long"))


def _long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


# Scans and projections


@_query(f"with {_SENTS} select doc_id, sent_idx, sent from sents")
def sentences_split(spark, d):
    return _sents(spark, d).select("doc_id", *_long("sent_idx"), "sent")


@_query(f"with {_SENTS} select cid, count(distinct doc_id) as n_docs, count(*) as n_sents from sents group by cid")
def sentence_counts_by_cluster(spark, d):
    per_doc = _sents(spark, d).groupBy("cid", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("cid").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_sents"))


@_query(f"with {_SENTS} select doc_id, sent_idx, len(regexp_extract_all(lower(sent), '[\\pL\\pN]+'))::bigint as n_words from sents where len(regexp_extract_all(lower(sent), '[\\pL\\pN]+')) >= 3")
def short_sentence_filter(spark, d):
    return _sents(spark, d).select("doc_id", *_long("sent_idx"), F.size(T.tokens(F.col("sent"))).cast("long").alias("n_words")).where("n_words >= 3")


@_query(f"with {_SENTS} select doc_id, sent_idx from sents where not contains(sent, '''''') and not contains(sent, '``') and not (starts_with(sent, '''') and (contains(lower(sent), 'says') or contains(lower(sent), 'said')))")
def dialogue_filter(spark, d):
    s = T.normal_sentence(F.col("sent"), drop_dialogue=True, quoted_speech=True)
    return _sents(spark, d).where(s.isNotNull()).select("doc_id", *_long("sent_idx"))


@_query(f"""with {_SENTS}, cut as (select doc_id, sent_idx, array_to_string(list_filter(string_split(trim(lower(sent)), ' '), lambda x: x not in ('the', 'of', 'and', 'a', 'to', 'in')), ' ') as sent_proc from sents)
select * from cut where sent_proc <> ''""")
def sentence_normalise(spark, d):
    s = T.normal_sentence(F.col("sent"), stop_words=("the", "of", "and", "a", "to", "in"))
    return _sents(spark, d).select("doc_id", *_long("sent_idx"), s.alias("sent_proc")).where("sent_proc is not null")


@_query("with l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as p from documents) select doc_id, i - 1 as para_idx, length(p[i]) as n_chars from l, unnest(range(1, len(p) + 1)) as u(i)")
def paragraph_split(spark, d):
    p = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return table(spark, d, "documents").select("doc_id", F.posexplode(p).alias("para_idx", "p")).select("doc_id", *_long("para_idx"), F.char_length("p").cast("long").alias("n_chars"))


@_query(r"select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, len(regexp_extract_all(html, '<p>'))::bigint as n_paras from pages")
def tag_extract(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<p>"), 0)).cast("long").alias("n_paras"))


@_query(f"with {_SENTS} select doc_id, sent_idx, sent from sents where sent_idx < 3")
def doc_head_limit(spark, d):
    return sentences_split(spark, d).where("sent_idx < 3")


@_query("select doc_id from (select doc_id, row_number() over (partition by source, text order by doc_id) as r from documents) where r = 1")
def exact_dedup_first(spark, d):
    rows = table(spark, d, "documents").select("source", F.sha2("text", 256).alias("h"), "doc_id")
    return rank.deduplicated(rows, ["source", "h"], "doc_id").select("doc_id")


@_query("select page_id, sha1(url) as url_hash from pages")
def url_sha1(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha1(F.col("url").cast("binary")).alias("url_hash"))


@_query(f"with {_SENTS} select doc_id || '_' || sent_idx as sid, cid, doc_id, sent_idx from sents")
def sid_compose_parse(spark, d):
    rows = _sents(spark, d).select(T.sid(F.col("doc_id"), F.col("sent_idx")).alias("sid"), "cid")
    return rows.select("sid", "cid", T.sid_part(F.col("sid"), 1).alias("doc_id"), T.sid_part(F.col("sid"), 2).alias("sent_idx"))


@_query("""with t as (select item_id, regexp_extract_all(lower(text), '[\\pL\\pN]+') as w from benchmark), g as (select item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' '))) as g from t, (values (1), (2), (3)) v(n))
select item_id, n::bigint as n, count(distinct g) as n_distinct from g group by all""")
def ngrams_distinct(spark, d):
    words = T.tokens(F.col("text"))
    parts = [table(spark, d, "benchmark").select("item_id", F.lit(n).cast("long").alias("n"), F.size(F.array_distinct(T.ngrams(words, n))).cast("long").alias("n_distinct")) for n in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("n_distinct > 0")


@_query(f"with {_TERMS} select term as token, sum(tf)::bigint as cnt from terms group by term order by cnt desc, token limit 200")
def vocab_topk(spark, d):
    words = documents(spark, d).select(F.explode(T.tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "token").limit(200)


@_query(f"with {_TERMS} select cid, term, sum(tf)::bigint as tf from terms group by all")
def term_tf(spark, d):
    return documents(spark, d).select("cid", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("cid", "term").agg(F.count("*").alias("tf"))


@_query(f"with {_TERMS} select cid, term, count(*) as df from terms group by all")
def term_df(spark, d):
    return score.term_counts(_sents(spark, d)).groupBy("cid", "term").agg(F.count("*").alias("df"))


# Relevance


@_query(_COUNT + " select * from every")
def rel_count(spark, d):
    return score.overlaps(_sents(spark, d), cluster_queries(spark, d)).select("cid", "doc_id", *_long("sent_idx"), "score")


def _lexical(spark, d, column):
    return score.lexical(_sents(spark, d), cluster_queries(spark, d)).select("cid", "doc_id", *_long("sent_idx"), F.col(column).alias("score"))


@_query(_REL + " select cid, doc_id, sent_idx, round(dot::double / qlen, 6) as score from rel")
def rel_weighted_count(spark, d):
    return _lexical(spark, d, "weighted_count")


@_query(_REL + " select cid, doc_id, sent_idx, round(coalesce(root / nullif(sqrt((slen::double) * qlen), 0), 0), 6) as score from rel")
def rel_bhattacharyya(spark, d):
    return _lexical(spark, d, "bhattacharyya")


@_query(_REL + " select cid, doc_id, sent_idx, round(coalesce(dot::double / nullif(sqrt((ssq::double) * qsq), 0), 0), 6) as score from rel")
def rel_tf_cosine(spark, d):
    return _lexical(spark, d, "tf_cosine")


@_query(_REL + " select cid, doc_id, sent_idx, round(coalesce(dot::double / nullif(sqrt((ssq::double) * qsq), 0), 0), 6) as score from rel")
def rel_tf_dot(spark, d):
    return _lexical(spark, d, "tf_cosine")


_CORPUS = f"with {_TERMS}, {_QS}, n as (select cid, count(*) + 1 as n from sents group by cid), df as (select cid, term, sum(c) as df from (select cid, term, count(*) as c from terms group by all union all select cid, term, 1 from qt) group by all)"


@_query(_CORPUS + """, idf as (select cid, term, ln((1 + n)::double / (1 + df)) + 1 as idf from df join n using (cid)), w as (select cid, doc_id, sent_idx, term, tf * idf as w from terms join idf using (cid, term)), q as (select cid, term, qtf * idf as qw from qt join idf using (cid, term)),
norms as (select cid, doc_id, sent_idx, sum(w * w) as s from w group by all), qn as (select cid, sum(qw * qw) as qs from q group by cid), dots as (select cid, doc_id, sent_idx, sum(w * qw) as dot from w join q using (cid, term) group by all)
select cid, doc_id, sent_idx, round(coalesce(dot / nullif(sqrt(s * qs), 0), 0), 6) as score from sents join qn using (cid) left join norms using (cid, doc_id, sent_idx) left join dots using (cid, doc_id, sent_idx)""")
def rel_tfidf_cosine(spark, d):
    return score.tfidf_cosine(_sents(spark, d), cluster_queries(spark, d)).select("cid", "doc_id", *_long("sent_idx"), "score")


@_query(_CORPUS + """, lens as (select cid, doc_id, sent_idx, sum(tf) as len from terms group by all), stats as (select cid, any_value(n) as n, (sum(len) + any_value(ql))::double / any_value(n) as avgdl from lens join n using (cid) join (select cid, sum(qtf) as ql from qt group by cid) using (cid) group by cid),
raw as (select cid, term, avgdl, ln((n - df + 0.5::double) / (df + 0.5::double)) as idf from df join stats using (cid)), mean as (select cid, avg(idf) as m from raw group by cid), idf as (select cid, term, qtf, avgdl, case when idf < 0 then 0.25::double * m else idf end as idf from qt join raw using (cid, term) join mean using (cid)),
part as (select cid, doc_id, sent_idx, sum(qtf * idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * len / avgdl))) as x from terms join idf using (cid, term) join lens using (cid, doc_id, sent_idx) group by all)
select cid, doc_id, sent_idx, round(coalesce(x, 0), 6) + 0.0 as score from sents join qs using (cid) left join part using (cid, doc_id, sent_idx)""")
def rel_bm25(spark, d):
    return score.bm25(_sents(spark, d), cluster_queries(spark, d)).select("cid", "doc_id", *_long("sent_idx"), "score")


@_query(f"with {_TERMS}, {_QS}, lens as (select cid, doc_id, sent_idx, sum(tf) as len from terms group by all), ql as (select cid, sum(qtf) as ql from qt group by cid), part as (select cid, doc_id, sent_idx, sum((tf / len) * ln((tf / len) / (coalesce(qtf / ql, 0) + 1e-6))) as x from terms join lens using (cid, doc_id, sent_idx) join ql using (cid) left join qt using (cid, term) group by all) select cid, doc_id, sent_idx, round(coalesce(x, 0), 6) as score from sents join qs using (cid) left join part using (cid, doc_id, sent_idx)")
def rel_kl(spark, d):
    return score.kl_divergence(_sents(spark, d), cluster_queries(spark, d)).select("cid", "doc_id", *_long("sent_idx"), "score")


@_query(_RANKED + " select cid, rank, doc_id, sent_idx, score from ranks where rank <= 5")
def tf_count_topk(spark, d):
    best = rank.top_k(_counts(spark, d), 5, "cid", "doc_id", "sent_idx")
    return best.select("cid", *_long("rank"), "doc_id", *_long("sent_idx"), "score")


# Filters over rank lists


@_query(f"with {_EVENTS}, t as (select *, coalesce(sum(cents) over (partition by user_id order by rank rows between unbounded preceding and 1 preceding), 0) as before, sum(greatest(cents, 0)) over (partition by user_id) as total from ranks) select user_id, event_id, rank from t where total <= 0 or 4 * before < 3 * total")
def filter_conf(spark, d):
    return rank.confident(_events(spark, d), 0.75, "user_id", value="cents").select("user_id", "event_id", *_long("rank"))


@_query(f"with {_EVENTS}, n as (select user_id, count(*) as n from ranks group by user_id) select user_id, event_id, rank from ranks join n using (user_id) where rank <= greatest(2, floor(n * 0.25::double))")
def filter_comp(spark, d):
    return rank.compressed(_events(spark, d), 0.25, "user_id", least=2).select("user_id", "event_id", *_long("rank"))


@_query(f"with {_EVENTS} select user_id, event_id, rank from ranks where rank <= 10")
def filter_topk(spark, d):
    return _events(spark, d).where("rank <= 10").select("user_id", "event_id", *_long("rank"))


@_query("select event_id from events where value > 1e-10::double")
def filter_prune(spark, d):
    return rank.pruned(table(spark, d, "events").withColumn("score", F.col("value"))).select("event_id")


@_query("with b as (select user_id, min(value) as lo, max(value) as hi from events group by user_id) select user_id, event_id, round(case when hi > lo then (value - lo) / (hi - lo) else 0 end, 6) as score from events join b using (user_id) where value is not null")
def minmax_norm(spark, d):
    return rank.min_max(_events(spark, d), "user_id", "value").select("user_id", "event_id", F.round("normed", 6).alias("score"))


@_query("with e as (select user_id, event_id, (round(value * 100))::bigint as cents from events where value is not null), t as (select user_id, sum(greatest(cents, 0)) as t from e group by user_id) select user_id, event_id, round(case when t > 0 then greatest(cents, 0)::double / t else 0 end, 6) as score from e join t using (user_id)")
def l1_norm(spark, d):
    return rank.l1(_events(spark, d), "user_id", "cents").select("user_id", "event_id", F.round("normed", 6).alias("score"))


@_query("with e as (select user_id, event_id, value / 100 as v from events where value is not null), h as (select user_id, max(v) as hi from e group by user_id), x as (select user_id, event_id, exp(v - hi) as x from e join h using (user_id)), t as (select user_id, sum(x) as t from x group by user_id) select user_id, event_id, round(x / t, 6) as score from x join t using (user_id)")
def softmax_norm(spark, d):
    return rank.softmax(_events(spark, d).withColumn("v", F.col("value") / 100), "user_id", "v").select("user_id", "event_id", F.round("normed", 6).alias("score"))


@_query(_REL + ", s as (select cid, doc_id, sent_idx, round(0.7::double * round(coalesce(dot::double / nullif(sqrt((ssq::double) * qsq), 0), 0), 6) + 0.3::double * round(dot::double / qlen, 6), 7) as score from rel) select cid, doc_id, sent_idx, score, row_number() over (partition by cid order by score desc, doc_id, sent_idx) as rank from s")
def interpolate_rerank(spark, d):
    both = score.lexical(_sents(spark, d), cluster_queries(spark, d))
    keys = ["cid", "doc_id", "sent_idx"]
    mixed = both.select(*keys, F.round(F.lit(0.7) * F.col("tf_cosine") + F.lit(0.3) * F.col("weighted_count"), 7).alias("score"))
    return rank.ranked(mixed, "cid", "doc_id", "sent_idx").select("cid", "doc_id", *_long("sent_idx"), "score", *_long("rank"))


@_query(_RANKED + ", w as (select cid, doc_id, sent_idx, rank, len(regexp_extract_all(lower(sent), '[\\pL\\pN]+')) as n from ranks join sents using (cid, doc_id, sent_idx)), c as (select *, sum(n) over (partition by cid order by rank) as cum_words from w) select cid, doc_id, sent_idx, cum_words::bigint as cum_words from c where cum_words - n < 250")
def word_budget_prefix(spark, d):
    rows = _top(spark, d, 250).withColumn("n_words", F.size("words").cast("long"))  # each row has a word of the query, so 250 rows reach the budget
    return rank.budgeted(rows, 250, "cid", bounded=True).select("cid", "doc_id", *_long("sent_idx"), "cum_words")


@_query(f"with {_EVENTS}, g(k) as (values (10), (20), (30), (50)) select k::int as k, count(*) as n_kept, sum(cents)::bigint as total from g join ranks on rank <= k group by k")
def sweep_topk(spark, d):
    return rank.sweep(_events(spark, d).withColumn("score", F.col("cents")), [10, 20, 30, 50], "user_id")


@_query(f"with {_EVENTS}, g(p) as (select unnest(range(1, 21))), t as (select *, coalesce(sum(cents) over (partition by user_id order by rank rows between unbounded preceding and 1 preceding), 0) as before, sum(greatest(cents, 0)) over (partition by user_id) as total from ranks) select p as twentieths, count(*) as n_kept from t, g where total <= 0 or 20 * before < p * total group by p")
def sweep_conf(spark, d):
    rows = rank.running(_events(spark, d), "user_id", "cents", "before")
    totals = rows.groupBy("user_id").agg(F.sum(F.greatest("cents", F.lit(0))).alias("total"))
    first = F.when(F.col("total") <= 0, 1).otherwise(F.greatest(F.lit(1), F.floor(20 * F.col("before") / F.col("total")) + 1))
    kept = rows.join(totals, "user_id").groupBy(first.cast("long").alias("twentieths")).agg(F.count("*").alias("n"))
    every = spark.range(1, 21).withColumnRenamed("id", "twentieths").join(kept, "twentieths", "left").na.fill(0)
    return every.select("twentieths", F.sum("n").over(W.orderBy("twentieths")).alias("n_kept"))


@_query(f"with {_EVENTS}, g(k) as (select unnest(range(1, 31))) select user_id, k::double as var, count(*) as n_kept, sum(cents)::bigint as total from g join ranks on rank <= k group by all")
def records_topk(spark, d):
    """Run records: the list that each setting keeps, for every length up to 30."""
    rows = rank.records(_events(spark, d).withColumn("score", F.col("cents")), "user_id", "topK", rank.FINE)
    return rows.groupBy("user_id", "var").agg(F.count("*").alias("n_kept"), F.sum("cents").alias("total"))


@_query(f"with {_EVENTS}, n as (select user_id, count(*) as n from ranks group by user_id), g(v) as (select unnest([0.1::double, 0.25, 0.5, 1.0])) select user_id, v as var, count(*) as n_kept from ranks join n using (user_id), g where rank <= v * n + 1e-12 group by all")
def records_comp(spark, d):
    return rank.records(_events(spark, d).withColumn("score", F.col("cents")), "user_id", "comp", [0.1, 0.25, 0.5, 1.0]).groupBy("user_id", "var").agg(F.count("*").alias("n_kept"))


@_query("select event_id, value as metric from events where value is not null order by value desc, event_id limit 3")
def best3_checkpoints(spark, d):
    return table(spark, d, "events").where("value is not null").orderBy(F.desc("value"), "event_id").limit(3).select("event_id", F.col("value").alias("metric"))


# Graphs


_PAIRS = f"with {_HEAD}, t as (select cid, i, doc_id, term, count(*)::double as w from (select cid, i, doc_id, unnest(regexp_extract_all(lower(sent), '[\\pL\\pN]+')) as term from head) group by all), n as (select cid, i, sum(w * w) as s from t group by all)"
_MET = ", p as (select a.cid, a.i, b.i as j, sum(a.w * b.w) as dot from t a join t b on a.cid = b.cid and a.term = b.term and a.i < b.i {extra} group by all), sims as (select p.cid, p.i, p.j, round(dot / sqrt(x.s * y.s), 6) as sim from p join n x on x.cid = p.cid and x.i = p.i join n y on y.cid = p.cid and y.i = p.j)"


@_query(_PAIRS + _MET.format(extra="") + " select * from sims")
def sim_pairs_cosine(spark, d):
    return score.similarity_pairs(_head(spark, d))


@_query(_PAIRS + _MET.format(extra="and a.doc_id <> b.doc_id") + " select * from sims")
def sim_cross_doc_only(spark, d):
    return score.similarity_pairs(_head(spark, d), cross_document=True)


@_query(_PAIRS + _MET.format(extra="") + ", b as (select cid, i, j, (round(sim * 1000000))::bigint as u from sims union all select cid, j, i, (round(sim * 1000000))::bigint from sims), c as (select cid, i, j, coalesce(sum(u) over (partition by cid, i order by u desc, j rows between unbounded preceding and 1 preceding), 0) as before, sum(u) over (partition by cid, i) as t from b) select cid, i, j from c where 2 * before < t")
def sim_mass_sparsify(spark, d):
    s = score.similarity_pairs(_head(spark, d)).withColumn("u", F.round(F.col("sim") * 1000000).cast("long"))
    both = s.select("cid", "i", "j", "u").unionByName(s.select("cid", F.col("j").alias("i"), F.col("i").alias("j"), "u"))
    rows = both.withColumn("node", F.struct("cid", "i"))
    return rank.confident(rank.ranked(rows, "node", "j", score="u", bounded=True), 0.5, "node", value="u", bounded=True).select("cid", "i", "j")


def _vectors(spark, d, most):
    """Each vector with the ``most`` lowest vectors of its cluster, its query sentences: an equi-join on the cluster."""
    v = table(spark, d, "embeddings").select("label", "vec_id", "embedding")
    q = rank.top_k(v.withColumn("score", -F.col("vec_id")), most, "label")
    return v.join(q.select("label", F.col("vec_id").alias("q_id"), F.col("embedding").alias("q")), "label").where("vec_id <> q_id")


def _similarities(kind):
    def run(spark, d):
        return _vectors(spark, d, 1).select("vec_id", "q_id", (F.round(score.vector_similarity(F.col("embedding"), F.col("q"), kind), 4) + F.lit(0.0)).alias("score"))

    run.__name__ = f"embedding_{kind}"
    return run


_VEC = "with r as (select *, row_number() over (partition by label order by vec_id) as r from embeddings), p as (select v.vec_id, q.vec_id as q_id, list_dot_product(v.embedding::double[], q.embedding::double[]) as dot, sqrt(list_dot_product(v.embedding::double[], v.embedding::double[])) * sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) as size from embeddings v join r q on q.label = v.label and q.vec_id <> v.vec_id and q.r <= {most}), c as (select *, coalesce(dot / nullif(size, 0), 0) as cos from p)"
for _kind, _formula in {"cosine": "cos", "rescaled": "(cos + 1) / 2", "angular": "1 - acos(least(greatest(cos, -1), 1)) / pi()", "tanh": "tanh(dot)", "sigmoid": "1 / (1 + exp(-dot))"}.items():
    _query(f"{_VEC.format(most=1)} select vec_id, q_id, round({_formula}, 4) + 0.0 as score from c")(_similarities(_kind))


@_query(f"{_VEC.format(most=3)} select vec_id, round(avg(cos), 4) + 0.0 as score from c group by vec_id")
def pool_avg(spark, d):
    return _vectors(spark, d, 3).groupBy("vec_id").agg((F.round(F.avg(score.vector_similarity(F.col("embedding"), F.col("q"))), 4) + F.lit(0.0)).alias("score"))


@_query(f"{_VEC.format(most=3)} select vec_id, round(max(cos), 4) + 0.0 as score from c group by vec_id")
def pool_max(spark, d):
    return _vectors(spark, d, 3).groupBy("vec_id").agg((F.round(F.max(score.vector_similarity(F.col("embedding"), F.col("q"))), 4) + F.lit(0.0)).alias("score"))


# ROUGE


def _grams_sql(name: str, rows: str, keys: str, n: int) -> str:
    """Counts of the n-grams of the relation ``rows(keys, w)``: words by position, n of them in a row."""
    joined = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"{name} as (select {keys}, {joined} as g, count(*) as c from (select {keys}, w, unnest(range(1, len(w) - {n - 2})) as i from {rows}) group by all)"


def _rouge_sql(n: int, name: str = "rouge", texts: str = "texts", refs: str = "ref_idx = 0") -> str:
    """``name(cid, doc_id, sent_idx, ref_idx, overlap, recall, f1)``: all pairs first, then what they share; nothing shared is 0."""
    s, r, m = f"s_{name}", f"r_{name}", f"m_{name}"
    return f"""{_grams_sql(s, texts, "cid, doc_id, sent_idx", n)}, {_grams_sql(r, "summaries", "cid, ref_idx", n)},
{m} as (select {s}.cid, doc_id, sent_idx, ref_idx, sum(least({s}.c, {r}.c)) as o from {s} join {r} on {s}.cid = {r}.cid and {s}.g = {r}.g group by all),
{name} as (select cid, doc_id, sent_idx, ref_idx, o, round(coalesce(o / nullif(rn, 0), 0), 6) as recall, round(coalesce(2 * o / nullif(sn + rn, 0), 0), 6) as f1
  from (select t.cid, t.doc_id, t.sent_idx, u.ref_idx, greatest(len(t.w) - {n - 1}, 0)::double as sn, greatest(len(u.w) - {n - 1}, 0)::double as rn, coalesce({m}.o, 0)::bigint as o
    from {texts} t join summaries u on t.cid = u.cid and u.{refs} left join {m} on {m}.cid = t.cid and {m}.doc_id = t.doc_id and {m}.sent_idx = t.sent_idx and {m}.ref_idx = u.ref_idx))"""


_SUMMARIES = f"{_REFS}, summaries as (select cid, ref_idx, regexp_extract_all(lower(text), '[\\pL\\pN]+') as w from refs)"
_TEXTS = f"with {_SENTS}, {_SUMMARIES}, texts as (select cid, doc_id, sent_idx, regexp_extract_all(lower(sent), '[\\pL\\pN]+') as w from sents)"
_KEYS = ["cid", "doc_id", "sent_idx"]


def _references(spark, d, one: bool = False):
    rows = references(spark, d)
    return (rows.where("ref_idx = 0") if one else rows).select("cid", "ref_idx", T.tokens(F.col("text")).alias("words"))


def _rouge(spark, d, kinds, one: bool = True):
    """Every sentence against its cluster's summary (the reference 0), or against all references."""
    sents = _sents(spark, d).select("cid", "doc_id", *_long("sent_idx"), T.tokens(F.col("sent")).alias("words"))
    return rouge.scores(sents, _references(spark, d, one), _KEYS, kinds)


@_query(f"{_TEXTS}, {_rouge_sql(1)} select cid, doc_id, sent_idx, o as overlap, recall, f1 from rouge")
def rouge1(spark, d):
    return _rouge(spark, d, 1).select(*_KEYS, "overlap", "recall", "f1")


@_query(f"{_TEXTS}, {_rouge_sql(2)} select cid, doc_id, sent_idx, o as overlap, recall, f1 from rouge")
def rouge2(spark, d):
    return _rouge(spark, d, 2).select(*_KEYS, "overlap", "recall", "f1")


@_query(f"""with {_DOCS}, {_SUMMARIES}, texts as (select cid, doc_id, 0 as sent_idx, regexp_extract_all(lower(text), '[\\pL\\pN]+')[1:250] as w from docs), {_rouge_sql(1, refs="ref_idx >= 0")}
select cid, doc_id, count(*) as n_refs, round(avg(recall), 7) as recall, round(avg(f1), 7) as f1 from rouge group by cid, doc_id""")
def rouge_multi_ref(spark, d):
    docs = documents(spark, d).select("cid", "doc_id", T.tokens(F.col("text")).alias("words"))
    each = rouge.scores(docs, _references(spark, d), ["cid", "doc_id"], 1, limit=250)
    return each.groupBy("cid", "doc_id").agg(F.count("*").alias("n_refs"), F.round(F.avg("recall"), 7).alias("recall"), F.round(F.avg("f1"), 7).alias("f1"))


@_query(f"{_TEXTS}, {_rouge_sql(1)} select cid, doc_id, sent_idx, f1 as f1_1 from rouge where f1 > 0.05")
def rouge_threshold(spark, d):
    return _rouge(spark, d, 1).where("f1 > 0.05").select(*_KEYS, F.col("f1").alias("f1_1"))


@_query(f"""{_TEXTS}, {_rouge_sql(1, "one")}, {_rouge_sql(2, "two")}
select cid, doc_id, sent_idx, round(0.85::double * two.f1 + 0.15::double * one.f1, 5) as label from one join two using (cid, doc_id, sent_idx)""")
def smoothed_label(spark, d):
    sents = _sents(spark, d).select("cid", "doc_id", *_long("sent_idx"), T.tokens(F.col("sent")).alias("words"))
    both = rouge.matched(sents, _references(spark, d, True), _KEYS, (1, 2))
    return both.select(*_KEYS, F.round(T.smoothed_label(rouge.f1(F.col("found")[0]), rouge.f1(F.col("found")[1])), 5).alias("label"))


@_query(f"{_TEXTS}, {_rouge_sql(2)} select count(*) filter (where f1 = 0) as n_zero, count(*) filter (where f1 < 0.05) as n_tiny, count(*) as n_all from rouge")
def zero_nonzero_counts(spark, d):
    return _rouge(spark, d, 2).agg(F.count_if(F.col("f1") == 0).alias("n_zero"), F.count_if(F.col("f1") < 0.05).alias("n_tiny"), F.count("*").alias("n_all"))


@_query(f"""{_TEXTS}, tails as (select cid, doc_id, sent_idx, w, -1 as ref_idx from texts union all select cid, null, null, w, ref_idx from summaries),
marked as (select cid, doc_id, sent_idx, ref_idx, len(w) as n, list_prepend('@start-token', w) as w from tails),
firsts as (select *, unnest(range(1, n + 2)) as i from marked), pairs as (select cid, doc_id, sent_idx, ref_idx, w[i] || ' ' || w[j] as g from firsts, unnest(range(i + 1, least(i + 5, n + 1) + 1)) as u(j)),
units as (select *, count(*) as c from (select * from pairs union all select cid, doc_id, sent_idx, ref_idx, w[i] as g from firsts where i > 1) group by all),
own as (select cid, doc_id, sent_idx, g, c from units where ref_idx < 0), theirs as (select cid, ref_idx, g, c as rc from units where ref_idx >= 0),
met as (select cid, doc_id, sent_idx, ref_idx, sum(least(c, rc)) as o from own join theirs using (cid, g) group by all), sn as (select cid, doc_id, sent_idx, sum(c) as s from own group by all), rn as (select cid, ref_idx, sum(rc) as r from theirs group by all)
select t.cid, t.doc_id, t.sent_idx, u.ref_idx, coalesce(o, 0)::bigint as overlap, round(coalesce(2 * coalesce(o, 0)::double / nullif(coalesce(s, 0) + coalesce(r, 0), 0), 0), 6) as f1
from texts t join summaries u on t.cid = u.cid left join met m on m.cid = t.cid and m.doc_id = t.doc_id and m.sent_idx = t.sent_idx and m.ref_idx = u.ref_idx
left join sn on sn.cid = t.cid and sn.doc_id = t.doc_id and sn.sent_idx = t.sent_idx left join rn on rn.cid = u.cid and rn.ref_idx = u.ref_idx""")
def rouge_su4(spark, d):
    return _rouge(spark, d, "su4", one=False).select(*_KEYS, "ref_idx", "overlap", "f1")


@_query()
def rouge_l(spark, d):
    return _rouge(spark, d, "l", one=False).select(*_KEYS, "ref_idx", F.col("overlap").alias("lcs"), "f1")


# Extraction


def _greedy_sql(budget: int, unit: str, threshold: float, block: int = 0, spare: bool = False) -> str:
    """``walk(cid, i, taken, used, passed, took)``: a step for each rank; a candidate knows which earlier ones it would repeat."""
    words = "regexp_extract_all(lower(sent), '[\\pL\\pN]+')"
    shared = ""
    if block:
        joined = " || ' ' || ".join(f"w[k + {x}]" for x in range(block))
        shared = f", grams as (select distinct cid, i, {joined} as g from (select cid, i, w, unnest(range(1, len(w) - {block - 2})) as k from cand0))"
    again = f"select cid, j, i from raw where sim >= {threshold}::double" + (" union select a.cid, b.i, a.i from grams a join grams b on a.cid = b.cid and a.g = b.g and a.i < b.i" if block else "")
    free = f"passed >= greatest(0, n_cand - {budget})" if spare else "false"
    return _PAIRS.replace("with ", "with recursive ", 1) + _MET.format(extra="") + f""", raw as (select p.cid, p.i, p.j, p.dot / sqrt(x.s * y.s) as sim from p join n x on x.cid = p.cid and x.i = p.i join n y on y.cid = p.cid and y.i = p.j),
cand0 as (select cid, i, {words} as w, count(*) over (partition by cid) as n_cand from head){shared}, bad as (select cid, j, list(i) as l from ({again}) group by cid, j),
cand as (select c.cid, c.i, w, n_cand, coalesce(l, []) as l from cand0 c left join bad on bad.cid = c.cid and bad.j = c.i),
walk as (select cid, -1::bigint as i, []::bigint[] as taken, 0::bigint as used, 0::bigint as passed, false as took from (select distinct cid from head)
  union all select cid, i, case when ok then list_append(taken, i) else taken end, used + case when ok then {"len(w)" if unit == "words" else "1"} else 0 end, passed + (not ok)::int, ok
  from (select walk.cid, cand.i, w, taken, used, passed, len(taken) = 0 or {free} or not list_has_any(taken, l) as ok from walk join cand on cand.cid = walk.cid and cand.i = walk.i + 1 where used < {budget})),
chosen as (select walk.cid, len(taken)::bigint as pos, walk.i, doc_id, sent_idx from walk join ranks on ranks.cid = walk.cid and ranks.rank = walk.i + 1 where took)"""


_CHOSEN = " select cid, pos, doc_id, sent_idx from chosen"


@_query(_greedy_sql(250, "words", 0.6) + _CHOSEN)
def greedy_word_budget(spark, d):
    return select.greedy(_top(spark, d), 250, "words", 0.6)


@_query(_greedy_sql(10, "sentences", 0.6) + _CHOSEN)
def greedy_sentence_budget(spark, d):
    return select.greedy(_top(spark, d), 10, "sentences", 0.6)


@_query(_greedy_sql(10, "sentences", 0.6, block=3) + _CHOSEN)
def ngram_block_greedy(spark, d):
    return select.greedy(_top(spark, d), 10, "sentences", 0.6, block=3)


@_query(_greedy_sql(10, "sentences", 0.4, spare=True) + _CHOSEN)
def skip_allowance_greedy(spark, d):
    return select.greedy(_top(spark, d), 10, "sentences", 0.4, skips="spare")


@_query()
def lexrank_rank(spark, d):
    return select.reranked(_top(spark, d), "lexrank")


@_query()
def wan_rank(spark, d):
    return select.reranked(_top(spark, d), "wan", omega=10)


@_query()
def mmr_rank(spark, d):
    return select.reranked(_top(spark, d), "mmr", weight=0.7)


@_query(_greedy_sql(250, "words", 0.6) + f""", {_SUMMARIES.replace(_REFS + ", ", "")}, texts as (select cid, 0 as doc_id, 0 as sent_idx, flatten(list(w order by pos))[1:250] as w from chosen join cand using (cid, i) group by cid), {_rouge_sql(2, refs="ref_idx >= 0")}
select cid, round(avg(recall), 6) as recall, round(avg(f1), 6) as f1 from rouge group by cid""")
def extract_evaluate(spark, d):
    """The whole way: rank, extract under a word budget, ROUGE-2 against the cluster's references."""
    chosen = select.greedy(_top(spark, d), 250, "words", 0.6, texts=True)
    texts = chosen.groupBy("cid").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "words"))), lambda x: x["words"])).alias("words"))
    return rouge.scores(texts, _references(spark, d), ["cid"], 2, limit=250).groupBy("cid").agg(rouge.mean("recall").alias("recall"), rouge.mean("f1").alias("f1"))


_SAMPLES = _COUNT.replace("with ", "with recursive ", 1) + """, best as (select cid, doc_id, max(score) as score from scores group by all), listed as (select *, row_number() over (partition by cid order by score desc, doc_id) - 1 as i from best),
cand as (select l.cid, l.i, l.doc_id, regexp_extract_all(lower(text), '[\\pL\\pN]+') as w from listed l join docs on docs.cid = l.cid and docs.doc_id = l.doc_id where i < 11),
t as (select cid, i, term, count(*)::double as c from (select cid, i, unnest(w) as term from cand) group by all), n as (select cid, i, sum(c * c) as s from t group by all),
pairs as (select a.cid, a.i, b.i as j, sum(a.c * b.c) as dot from t a join t b on a.cid = b.cid and a.term = b.term and a.i < b.i group by all),
bad as (select p.cid, p.j, list(p.i) as l from pairs p join n x on x.cid = p.cid and x.i = p.i join n y on y.cid = p.cid and y.i = p.j where dot / sqrt(x.s * y.s) >= 0.6::double group by p.cid, p.j),
walk as (select cid, 0::bigint as i, [0]::bigint[] as taken, len(w)::bigint as size, 0::bigint as missed, true as took from cand where i = 0
  union all select cid, i, case when fits then list_append(taken, i) else taken end, size + case when fits then len(w) else 0 end, missed + (not same and not fits)::int, fits
  from (select walk.cid, c.i, w, taken, size, missed, list_has_any(taken, coalesce(l, [])) as same, not list_has_any(taken, coalesce(l, [])) and abs(size + len(w) - 250) <= abs(size - 250) as fits
    from walk join cand c on c.cid = walk.cid and c.i = walk.i + 1 left join bad on bad.cid = c.cid and bad.j = c.i where missed < 5))
select regexp_extract(walk.cid, '[0-9]+$')::bigint as cluster_id, (len(taken) - 1)::bigint as pos, doc_id as sample_id from walk join cand using (cid, i) where took"""


@_query(_SAMPLES)
def sample_cluster_build(spark, d):
    """A cluster of samples for each source; its rank list is the retrieval's: the ten documents with the best sentences for its query."""
    best = _counts(spark, d).groupBy("cid", "doc_id").agg(F.max("score").alias("score"))
    lists = rank.top_k(best, 11, "cid", "doc_id").join(documents(spark, d), ["cid", "doc_id"])
    lists = lists.select(F.regexp_extract("cid", "[0-9]+$", 0).cast("long").alias("cluster_id"), (F.col("rank") - 1).alias("rank"), F.col("doc_id").alias("sample_id"), T.tokens(F.col("text")).alias("words"))
    return select.sample_clusters(lists)


# Rows for training and generation


@_query("select doc_id, '[unused' || case when n < 100 then 85 when n >= 400 then 400 else 100 + ((n - 100) // 15) * 15 end || ']' as token from (select doc_id, len(regexp_extract_all(lower(text), '[\\pL\\pN]+')) as n from documents)")
def len_token_bucket(spark, d):
    return table(spark, d, "documents").select("doc_id", T.length_token(F.size(T.tokens(F.col("text")))).alias("token"))


def _mask_sql() -> str:
    low, out = "lower(replace(text, '?', '.'))", "lower(replace(text, '?', '.'))"
    for w in T.WH_WORDS:
        out = f"replace({out}, '{w}', '[MASK]')"
    steps = [f"a as (select conv_id, turn, {low} as low, {out} as m from conversations where role = 'user')"]
    for i, w in enumerate(T.BINARY_VERBS):
        steps.append(f"a{i} as (select conv_id, turn, low, case when starts_with(m, '{w}') then replace(m, '{w}', '[MASK]') else m end as m from {'a' if not i else f'a{i - 1}'})")
    command = "low"
    for w in T.COMMANDS:
        command = f"replace({command}, '{w} ', '[MASK] ')"
    return f"with {', '.join(steps)} select conv_id, turn, case when m <> low then m else {command} end as masked from a{len(T.BINARY_VERBS) - 1}"


@_query(_mask_sql())
def query_mask(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.mask_question(F.col("text")).alias("masked"))


@_query("select conv_id, string_agg(regexp_replace(text, '\\.$', ''), ' [SUBQUERY] ' order by turn) as text from conversations where role = 'user' group by conv_id")
def mask_with_sub(spark, d):
    turns = table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", T.join_subqueries(F.transform("t", lambda x: x["text"])).alias("text"))


@_query("select item_id, mode, case mode when 'plain' then text when 'both' then '[MASK] ' || text || ' [MASK]' when 'lead' then '[MASK] ' || text else '[MASK] ' || text || ' .' end as text from benchmark, (values ('plain'), ('both'), ('lead'), ('stop')) v(mode)")
def query_decorate(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", "text", F.explode(F.array(*map(F.lit, ("plain", "both", "lead", "stop")))).alias("mode"))
    return rows.select("item_id", "mode", T.decorate(F.col("text"), F.col("mode")).alias("text"))


@_query("with t as (select conv_id, list(text order by turn) as l from conversations where role = 'user' group by conv_id) select conv_id, 'describe ' || trim(l[1]) || case when ends_with(trim(l[1]), '.') then ' ' else '. ' end || array_to_string(l[2:], ' ') as text from t")
def title_narr_text(spark, d):
    turns = table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("l"))
    return turns.select("conv_id", T.title_text(F.col("l")[0], F.array_join(F.slice("l", 2, 1000000), " ")).alias("text"))


@_query("with w as (select doc_id, list_transform(regexp_extract_all(lower(text), '[\\pL\\pN]+'), lambda x: case when length(x) > 4 then '[MASK]' else x end) as w from documents), m as (select doc_id, w, [w[i] for i in range(1, len(w) + 1) if i = 1 or w[i] <> '[MASK]' or w[i-1] <> '[MASK]'] as m from w) select doc_id, len(list_filter(w, lambda x: x = '[MASK]'))::bigint as n_mask, array_to_string(m, ' ') as merged from m")
def mask_merge(spark, d):
    words = F.transform(T.tokens(F.col("text")), lambda x: F.when(F.length(x) > 4, T.MASK).otherwise(x))
    rows = table(spark, d, "documents").select("doc_id", words.alias("w"))
    merged = T.merge_masks(F.col("w"))
    return rows.select("doc_id", F.size(F.filter("w", lambda x: x == T.MASK)).cast("long").alias("n_mask"), F.array_join(merged, " ").alias("merged"))


_PAIR = "p as (select a.conv_id, a.turn, a.text as src, b.text as tgt from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.role = 'user' and b.role = 'assistant')"


def _turns(spark, d):
    c = table(spark, d, "conversations")
    answers = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt"))
    return c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("src")).join(answers, ["conv_id", "turn"])


@_query(f"with {_PAIR}, n as (select conv_id, turn, len(regexp_extract_all(lower(src), '[\\pL\\pN]+')) as a, len(regexp_extract_all(lower(tgt), '[\\pL\\pN]+')) as b from p), k as (select *, case when a + b <= 61 then a else least(a, greatest(61 - b, 31)) end as keep_a from n) select conv_id, turn, keep_a::bigint as keep_a, least(b, 61 - keep_a)::bigint as keep_b from k")
def pair_truncate(spark, d):
    rows = _turns(spark, d).select("conv_id", "turn", F.size(T.tokens(F.col("src"))).alias("a"), F.size(T.tokens(F.col("tgt"))).alias("b"))
    a, b = T.pair_lengths(F.col("a"), F.col("b"), 61)
    return rows.select("conv_id", "turn", a.cast("long").alias("keep_a"), b.cast("long").alias("keep_b"))


@_query(f"with {_SENTS}, w as (select doc_id, sent_idx, len(regexp_extract_all(lower(sent), '[\\pL\\pN]+')) as n from sents where sent_idx < 10), c as (select doc_id, sent_idx, n, coalesce(sum(n) over (partition by doc_id order by sent_idx rows between unbounded preceding and 1 preceding), 0) as before from w) select doc_id, sent_idx, least(n, greatest(100 - before, 0))::bigint as kept_words from c where before < 100")
def clip_nested(spark, d):
    rows = _sents(spark, d).where("sent_idx < 10").select("doc_id", *_long("sent_idx"), F.size(T.tokens(F.col("sent"))).cast("long").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("doc_id").orderBy("sent_idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("before", before).where("before < 100").select("doc_id", "sent_idx", F.least("n", 100 - F.col("before")).alias("kept_words"))


@_query("with l as (select doc_id, string_split(text, chr(10)) as l from documents) select doc_id, i - 1 as line_no, case when l[i] = '' or regexp_matches(l[i], '[.!?…''`\")’”]$') then l[i] else l[i] || ' .' end as fixed from l, unnest(range(1, len(l) + 1)) as u(i)")
def missing_period(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.select("doc_id", *_long("line_no"), T.missing_period(F.col("line")).alias("fixed"))


@_query(f"with {_PAIR} select conv_id || '_' || turn as uid, src, tgt from p")
def src_tgt_rows(spark, d):
    return _turns(spark, d).select(T.sid(F.col("conv_id"), F.col("turn")).alias("uid"), "src", "tgt")


@_query(f"with {_PAIR} select conv_id, turn from p where len(regexp_extract_all(lower(tgt), '[\\pL\\pN]+')) >= 50")
def min_target_words(spark, d):
    return _turns(spark, d).where(F.size(T.tokens(F.col("tgt"))) >= 50).select("conv_id", "turn")


@_query(f"with {_SENTS}, r as (select *, row_number() over (partition by cid order by sent_idx, doc_id) as p from sents) select cid, doc_id, sent_idx from r where p <= 20")
def round_robin_pos(spark, d):
    p = F.row_number().over(W.partitionBy("cid").orderBy("sent_idx", "doc_id"))
    return _sents(spark, d).select("cid", "doc_id", *_long("sent_idx")).withColumn("p", p).where("p <= 20").drop("p")


@_query(f"with {_SENTS}, r as (select *, row_number() over (partition by cid order by md5('2020:' || doc_id || ':' || sent_idx), doc_id, sent_idx) as p from sents where sent_idx > 2) select cid, doc_id, sent_idx from r where p <= 20")
def hash_neg_sample(spark, d):
    h = F.md5(F.concat_ws(":", F.lit("2020"), F.col("doc_id").cast("string"), F.col("sent_idx").cast("string")))
    p = F.row_number().over(W.partitionBy("cid").orderBy(h, "doc_id", "sent_idx"))
    return _sents(spark, d).where("sent_idx > 2").select("cid", "doc_id", *_long("sent_idx")).withColumn("p", p).where("p <= 20").drop("p")


@_query()
def masked_summaries(spark, d):
    """Facts made up from word positions stand in for a parser: every fifth word a verb, its neighbours the arguments."""
    words = T.tokens(F.col("text"))
    tags = F.transform("w", lambda x, i: F.when(i % 5 == 2, "B-V").when(i % 5 == 1, "B-ARG0").when(i % 5 == 3, "B-ARG1").otherwise("O"))
    rows = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("cid"), words.alias("w")).withColumn("t", tags)
    parse = F.array(F.struct(F.col("w").alias("words"), F.array(F.struct(F.col("t").alias("tags"))).alias("verbs"), F.array_join("w", " ").alias("raw_sentence")))
    out = mask.masked_summaries(rows.select("cid", parse.alias("open_ie")), mask.Masking(ratio=0.3, verb_as_slot=True))
    return out.select("cid", F.array_join("masked_seq", " ").alias("masked"), "n_revealed")


# Joins, sets, statistics


@_query(f"""with {_SENTS}, members as (select item_id as cluster_id, unnest([0, 1, 2]) as pos, item_id * 2 + unnest([0, 1, 2]) * 149 as doc_id from benchmark),
own as (select doc_id, list(sent order by sent_idx) as sents from sents group by doc_id) select cluster_id, pos::bigint as pos, doc_id, coalesce(len(sents), 0)::bigint as n_sents, coalesce(array_to_string(sents[1:2], ' '), '') as head from members left join own using (doc_id)""")
def left_default_join(spark, d):
    """Samples of three documents, of which some are missing: a missing one has an empty list."""
    members = table(spark, d, "benchmark").select(F.col("item_id").alias("cluster_id"), F.posexplode(F.transform(F.array(*map(F.lit, (0, 1, 2))), lambda k: F.col("item_id") * 2 + k * 149)).alias("pos", "doc_id"))
    return assemble.member_sentences(members, _sents(spark, d)).select("cluster_id", *_long("pos"), "doc_id", F.size("sents").cast("long").alias("n_sents"), F.array_join(F.slice("sents", 1, 2), " ").alias("head"))


@_query("select p_partkey as left_id, n_nationkey as right_id from part, nation where starts_with(lower(p_name), lower(n_name[1:1 + n_nationkey % 2]))")
def theta_prefix_join(spark, d):
    """Names that begin with a prefix of one or two letters: an equi-join on every prefix of a name."""
    names = table(spark, d, "nation").select(F.expr("substring(n_name, 1, int(1 + n_nationkey % 2))").alias("prefix"), F.col("n_nationkey").alias("right_id"))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("left_id"), F.col("p_name").alias("cid"))
    hits = assemble.prefix_matches(names, parts.select("cid").distinct(), fold=True)
    return hits.join(parts, "cid").select("left_id", "right_id")


@_query("with u as (select doc_id as key, 'label' || quality as value, 0 as p from labels union all select doc_id, 'lang_' || lang, 1 from documents) select key, value from (select *, row_number() over (partition by key order by p) as r from u) where r = 1")
def dict_merge_precedence(spark, d):
    first = table(spark, d, "labels").select(F.col("doc_id").alias("key"), F.concat(F.lit("label"), F.col("quality").cast("string")).alias("value"), F.lit(0).alias("p"))
    second = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.concat(F.lit("lang_"), F.col("lang")).alias("value"), F.lit(1).alias("p"))
    return rank.deduplicated(first.unionByName(second), ["key"], "p").select("key", "value")


@_query("with o as (select o_orderkey as cid, year(o_orderdate) as year, o_custkey from orders) select cid, case when year = 1997 then 'test' when o_custkey in (select c_custkey from customer where c_nationkey = 3) then 'dev' else 'train' end as split from o where cid % 7 <> 3")
def year_split(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("cid"), F.year("o_orderdate").alias("year"), "o_custkey")
    dev = rows.join(table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    return assemble.split(rows, "cid", "year", 1997, dev, rows.where("cid % 7 = 3")).select("cid", "split")


@_query("with j as (select quality, n_chars from labels join documents using (doc_id)), r as (select quality, n_chars, rank() over (order by quality) + (count(*) over (partition by quality) - 1) / 2.0::double as a, rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2.0::double as b from j), c as (select corr(quality::double, n_chars::double) as p, corr(a, b) as s from r) select round(p, 6) as pearson, round(s, 6) as spearman, round((p + s) / 2, 6) as corr from c")
def corr_pearson_spearman(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select("quality", "n_chars")
    return metrics.pearson_spearman(rows, "quality", "n_chars")


@_query("with j as (select quality as y, least(n_chars / 2000.0::double, 1) as s from labels join documents using (doc_id)), c as (select count(*) filter (where s >= 0.5 and y = 1)::double as tp, count(*) filter (where s >= 0.5) as pp, count(*) filter (where y = 1) as p, sqrt(avg((y - s) * (y - s))) as e from j) select round(coalesce(tp / nullif(pp, 0), 0), 6) as precision, round(coalesce(tp / nullif(p, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(pp + p, 0), 0), 6) as f1, round(e, 6) as rmse from c")
def binary_metrics(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("y"), F.least(F.col("n_chars") / 2000.0, F.lit(1.0)).alias("s"))
    return metrics.binary(rows, "y", "s", 0.5)


_MULTILABEL = "with v as (select vec_id, embedding as e, label from embeddings), p as (select vec_id, list_transform(e, lambda x: case when x >= 0.15 then 1 else 0 end) as pred, list_transform(range(0, len(e)), lambda i: case when i % 8 = label % 8 or i % 8 = (label + 1) % 8 then 1 else 0 end) as truth from v), c as (select vec_id, list_sum(list_transform(range(1, len(pred) + 1), lambda i: pred[i] * truth[i]))::double as tp, list_sum(pred) as pp, list_sum(truth) as t from p), rows as (select vec_id, round(coalesce(tp / nullif(pp, 0), 0), 6) as p, round(tp / t, 6) as r from c)"


@_query(_MULTILABEL + " select * from rows")
def multilabel_pr(spark, d):
    pred = F.transform("embedding", lambda x: (x.cast("double") >= 0.15).cast("int"))
    truth = F.transform("embedding", lambda x, i: ((i % 8 == F.col("label") % 8) | (i % 8 == (F.col("label") + 1) % 8)).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    rows = table(spark, d, "embeddings").select("vec_id", pred.alias("a"), truth.alias("b"))
    tp = total(F.zip_with("a", "b", lambda x, y: x * y)).cast("double")
    return rows.select("vec_id", F.round(F.coalesce(F.try_divide(tp, total("a")), F.lit(0.0)), 6).alias("p"), F.round(tp / total("b"), 6).alias("r"))


@_query("with v as (select vec_id, embedding as e from embeddings) select vec_id, list_transform(range(1, len(e) + 1), lambda i: case when list_max(e) >= 0.25 then (e[i] >= 0.25)::int else (i = list_position(e, list_max(e)))::int end) as pred from v")
def max_alternative(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("e")).withColumn("m", F.array_max("e")).withColumn("at", F.array_position("e", F.col("m")) - 1)
    return rows.select("vec_id", F.transform("e", lambda x, i: F.when(F.col("m") >= 0.25, x >= 0.25).otherwise(i == F.col("at")).cast("int")).alias("pred"))


@_query(f"{_MULTILABEL}, m as (select avg(p) as p, avg(r) as r from rows) select round(p, 6) as p, round(r, 6) as r, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f1 from m")
def example_based_f1(spark, d):
    return metrics.example_based(multilabel_pr(spark, d))


@_query("with h as (select least(floor((n_chars - 0.0::double) * 20 / 10000), 19)::bigint as bucket from documents where n_chars between 0 and 10000), c as (select bucket, count(*) as cnt from h group by bucket) select bucket, cnt, round(cnt::double / sum(cnt) over (), 6) as ratio from c")
def histogram_fixed(spark, d):
    return metrics.histogram(table(spark, d, "documents"), "n_chars", 0, 10000, 20)


@_query("with w as (select source as cid, len(regexp_extract_all(lower(text), '[\\pL\\pN]+')) as n from documents), c as (select cid, count(*) as docs, sum(n) as words from w group by cid) select round(avg(docs), 4) as avg_docs, round(avg(words), 4) as avg_words, count(*) as n_clusters from c")
def cluster_stats(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("cid"), F.size(T.tokens(F.col("text"))).cast("long").alias("n"))
    per = rows.groupBy("cid").agg(F.count("*").alias("docs"), F.sum("n").alias("words"))
    return per.agg(F.round(F.avg("docs"), 4).alias("avg_docs"), F.round(F.avg("words"), 4).alias("avg_words"), F.count("*").alias("n_clusters"))


__all__ = ["oracle_sql", "queries", "tables"]
