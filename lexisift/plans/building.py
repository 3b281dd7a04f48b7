"""Queries over the rows for training and generation: orders, merges, samples, sub-summaries, sources, similarity variants."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexisift.functions import text as T
from lexisift.operators import assemble, mask, rank, rouge, score
from lexisift.plans import drivers
from lexisift.plans.catalogue import _HEAD, _PAIRS, _MET, _QS, _RANKED, _REFS, _REL, _SENTS, _SUMMARIES, _head, _long, _query, _rouge_sql, _sents, _top, sim_pairs_cosine
from lexisift.sources import tables
from lexisift.sources.tables import documents, references, table
from lexisift.sources.tables import queries as cluster_queries

_BEST = _RANKED + ", best as (select cid, doc_id, sent_idx, sent, score, rank from ranks join sents using (cid, doc_id, sent_idx) where rank <= 30)"
_LOCAL = _BEST + """, m as (select cid, doc_id, avg(score) as mean, min(rank) as head from best group by all),
placed as (select b.*, row_number() over (partition by b.cid order by mean desc, head, sent_idx) as pos from best b join m using (cid, doc_id))"""
_TARGET = f"{_REFS}, tgts as (select cid, text as tgt, len(regexp_extract_all(lower(text), '[\\pL\\pN]+')) as n from refs where ref_idx = 0)"
_TOKEN = "'[unused' || case when n < 100 then 85 when n >= 400 then 400 else 100 + ((n - 100) // 15) * 15 end || '] '"


def _best(spark, d):
    return _top(spark, d, 30)


def _targets(spark, d):
    return references(spark, d).where("ref_idx = 0").select("cid", F.col("text").alias("tgt"))


@_query(_LOCAL + " select cid, pos, doc_id, sent_idx from placed")
def local_order(spark, d):
    return assemble.local_order(_best(spark, d)).select("cid", *_long("pos"), "doc_id", *_long("sent_idx"))


@_query("""with l as (select user_id, event_id, event_type, value, row_number() over (partition by user_id, event_type order by value desc, event_id) as rank, dense_rank() over (order by event_type) as list_no from events where value is not null)
select user_id, event_id, row_number() over (partition by user_id order by value desc, list_no, rank) as merged_rank from l""")
def merge_lists(spark, d):
    rows = table(spark, d, "events").where("value is not null").select("user_id", "event_id", F.col("event_type").alias("list_no"), F.col("value").alias("score"))
    lists = rank.ranked(rows, ["user_id", "list_no"], "event_id")
    return assemble.merged_lists(lists, "user_id").select("user_id", "event_id", *_long("merged_rank"))


@_query(f"""with {_SENTS}, p as (select cid, doc_id, sent_idx from (select *, row_number() over (partition by cid order by sent_idx, doc_id) as r from sents) where r <= 20),
n as (select cid, doc_id, sent_idx from (select s.*, row_number() over (partition by cid order by md5('2020:' || doc_id || ':' || sent_idx), doc_id, sent_idx) as r from sents s anti join p using (cid, doc_id, sent_idx)) where r <= 20)
select cid, doc_id, sent_idx, true as positive from p union all select cid, doc_id, sent_idx, false from n""")
def positives_negatives(spark, d):
    return assemble.positives_and_negatives(_sents(spark, d)).select("cid", "doc_id", *_long("sent_idx"), "positive")


@_query(f"""with {_SENTS}, n as (select *, count(*) over (partition by cid, doc_id) as n from sents), r as (select *, row_number() over (partition by cid, doc_id, sent_idx < 3 order by md5('2020:' || doc_id || ':' || sent_idx), sent_idx) as r from n where n >= 6)
select cid, doc_id, sent_idx from r where sent_idx < 3 or r <= 3""")
def lead_others_sample(spark, d):
    return assemble.lead_and_others(_sents(spark, d)).select("cid", "doc_id", *_long("sent_idx"))


@_query("""with c as (select year(o_orderdate) as year, o_orderkey as cid from orders), r as (select *, row_number() over (partition by year order by md5('2020:' || year || ':' || cid), cid) as r from c)
select year::bigint as year, cid from r where r <= 5""")
def yearly_cluster_sample(spark, d):
    rows = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderkey").alias("cid"))
    return assemble.sampled_clusters(rows, 5).select(*_long("year"), "cid")


@_query(_BEST + """, w as (select cid, rank as pos, doc_id, sent_idx, len(regexp_extract_all(lower(sent), '[\\pL\\pN]+')) as n from best), c as (select *, sum(n) over (partition by cid order by pos) as cum, sum(n) over (partition by cid) as total from w)
select cid, pos, doc_id, sent_idx from c where total >= 100 and cum - n < 100""")
def lead_words(spark, d):
    rows = _best(spark, d).select("cid", F.col("rank").alias("pos"), "doc_id", "sent_idx", F.size("words").cast("long").alias("n_words"))
    return assemble.lead(rows, 100).select("cid", *_long("pos"), "doc_id", *_long("sent_idx"))


@_query()
def subsummary_integration(spark, d):
    """The answers of a conversation as the sub-summaries of its questions."""
    turns = table(spark, d, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", assemble.joined_subsummaries(F.transform("t", lambda x: x["text"]), 60).alias("text"))


@_query(_BEST + f", {_TARGET}, src as (select cid, string_agg(sent, ' ' order by rank) as src from best group by cid) select cid, {_TOKEN} || src as src, tgt from src join tgts using (cid)".replace(_REFS + ", ", ""))
def generator_rows_by_rank(spark, d):
    return assemble.generator_rows(assemble.sources(_best(spark, d), "rank"), _targets(spark, d))


@_query(_LOCAL + f", {_TARGET}, src as (select cid, string_agg(sent, ' ' order by pos) as src from placed group by cid) select cid, {_TOKEN} || src as src, tgt from src join tgts using (cid)".replace(_REFS + ", ", ""))
def generator_rows_by_position(spark, d):
    return assemble.generator_rows(assemble.sources(assemble.local_order(_best(spark, d)), "pos"), _targets(spark, d))


@_query(_REL + """, s as (select cid, doc_id, sent_idx, round(coalesce(dot::double / nullif(sqrt((ssq::double) * qsq), 0), 0), 6) as estimated from rel), r as (select *, row_number() over (partition by cid order by estimated desc, doc_id, sent_idx) as rank from s)
select doc_id || '_' || sent_idx as sid, cid, rank, estimated from r where rank <= 30""")
def estimated_label_rows(spark, d):
    """A scorer's predictions as rows of estimated labels, best first."""
    scores = score.lexical(_sents(spark, d), cluster_queries(spark, d)).select("cid", "doc_id", "sent_idx", F.col("tf_cosine").alias("score"))
    best = rank.top_k(scores, 30, "cid", "doc_id", "sent_idx")
    return best.select(T.sid(F.col("doc_id"), F.col("sent_idx")).alias("sid"), "cid", *_long("rank"), F.col("score").alias("estimated"))


@_query("""select b.item_id, '[MASK] ' || b.text || ' .' || coalesce(' ' || c.text, '') as text from benchmark b left join conversations c on c.conv_id = b.item_id and c.turn = 1""")
def query_expansion(spark, d):
    """A query and its predicted answer; a query without one stays alone."""
    answers = table(spark, d, "conversations").where("turn = 1").select(F.col("conv_id").alias("item_id"), F.col("text").alias("prediction"))
    rows = table(spark, d, "benchmark").join(answers, "item_id", "left")
    return rows.select("item_id", T.decorate(F.col("text"), F.lit("expanded"), F.col("prediction")).alias("text"))


@_query("select distinct item_id, source as cid from benchmark join documents on starts_with(source, 'src' || (item_id % 20))")
def prefix_reference_match(spark, d):
    names = references(spark, d).select(F.col("cid").alias("prefix"), "item_id")
    return assemble.prefix_matches(names, documents(spark, d).select("cid").distinct()).select("item_id", "cid")


@_query(f"with {_SENTS} select doc_id, sent_idx, quality from sents join labels using (doc_id)")
def label_per_sentence(spark, d):
    return _sents(spark, d).select("doc_id", *_long("sent_idx")).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@_query(_PAIRS + _MET.format(extra="") + ", e as (select cid, min(sim) as lo, max(sim) as hi from sims group by cid) select cid, i, j, round(case when hi > lo then (sim - lo) / (hi - lo) else 0 end, 6) as sim from sims join e using (cid)")
def sim_conditioned(spark, d):
    return assemble.conditioned(sim_pairs_cosine(spark, d)).select("cid", "i", "j", F.round("sim", 6).alias("sim"))


@_query(f"with {_HEAD}" + """, dt as (select distinct cid, doc_id, unnest(regexp_extract_all(lower(text), '[\\pL\\pN]+')) as term from docs), n as (select cid, count(distinct doc_id) as n from docs group by cid), df as (select cid, term, count(*) as df from dt group by all),
tf as (select cid, i, term, count(*) as tf from (select cid, i, unnest(regexp_extract_all(lower(sent), '[\\pL\\pN]+')) as term from head) group by all), w as (select cid, i, term, tf * ln(n::double / df) as w from tf join df using (cid, term) join n using (cid) where term not in ('the', 'of', 'and', 'a', 'to', 'in') and n > df),
s as (select cid, i, sum(w * w) as s from w group by all), p as (select a.cid, a.i, b.i as j, sum(a.w * b.w) as dot from w a join w b on a.cid = b.cid and a.term = b.term and a.i < b.i group by all) select p.cid, p.i, p.j, round(dot / sqrt(x.s * y.s), 6) as sim from p join s x on x.cid = p.cid and x.i = p.i join s y on y.cid = p.cid and y.i = p.j""")
def sim_pairs_document_idf(spark, d):
    return score.similarity_pairs_by_documents(_head(spark, d), documents(spark, d), ("the", "of", "and", "a", "to", "in"))


_BM25_PAIRS = f"with {_HEAD}" + """, t as (select cid, i, term, count(*) as tf from (select cid, i, unnest(regexp_extract_all(lower(sent), '[\\pL\\pN]+')) as term from head) group by all), lens as (select cid, i, sum(tf) as len from t group by all),
stats as (select cid, count(*) as n, avg(len) as avgdl from lens group by cid), raw as (select cid, term, any_value(avgdl) as avgdl, ln((any_value(n) - count(*) + 0.5::double) / (count(*) + 0.5::double)) as idf from t join stats using (cid) group by all),
mean as (select cid, avg(idf) as m from raw group by cid), idf as (select cid, term, avgdl, case when idf < 0 then 0.25::double * m else idf end as idf from raw join mean using (cid)),
w as (select cid, i as j, term, idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * len / avgdl)) as w from t join lens using (cid, i) join idf using (cid, term)),
sims as (select t.cid, t.i, w.j, round(sum(t.tf * w.w), 6) + 0.0 as sim from t join w on t.cid = w.cid and t.term = w.term and t.i <> w.j group by all)"""


@_query(_BM25_PAIRS + " select * from sims")
def sim_pairs_bm25(spark, d):
    return score.bm25_pairs(_head(spark, d))


@_query("""with n as (select vec_id, embedding as e, label % 8 + 1 as n from embeddings) select vec_id, n::bigint as n_valid, round(list_sum(list_transform(range(0, n), lambda t: e[t * 8 + 1]::double)) / n, 6) + 0.0 as first, round(list_sum(list_transform(range(0, n), lambda t: e[t * 8 + 8]::double)) / n, 6) + 0.0 as last from n""")
def masked_mean_pool(spark, d):
    """Vectors read as eight tokens of eight numbers, the first ``n_valid`` of them real."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.transform(F.slice("embedding", t * 8 + 1, F.lit(8)), lambda x: x.cast("double")))
    rows = table(spark, d, "embeddings").select("vec_id", (F.col("label") % 8 + 1).cast("long").alias("n_valid"), tokens.alias("t"))
    pooled = rows.withColumn("p", assemble.masked_mean(F.col("t"), F.col("n_valid")))
    return pooled.select("vec_id", "n_valid", (F.round(F.col("p")[0], 6) + 0.0).alias("first"), (F.round(F.col("p")[7], 6) + 0.0).alias("last"))


@_query("""with e as (select user_id, event_id, event_type, (round(value * 100))::bigint as cents from events where value is not null), w as (select event_type, count(*) % 7 as weight from events group by event_type having count(*) % 7 > 0) select event_id, (cents * coalesce(weight, 0))::bigint as score from e left join w using (event_type)""")
def weighted_scores(spark, d):
    rows = table(spark, d, "events").where("value is not null").select("event_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("score"))
    weights = table(spark, d, "events").groupBy("event_type").agg((F.count("*") % 7).alias("weight")).where("weight > 0")
    return assemble.weighted(rows, weights, ["event_type"]).select("event_id", F.col("score").cast("long").alias("score"))


@_query()
def swapped_ranks(spark, d):
    return assemble.swapped(_best(spark, d), 0.3)


_WORDS = "regexp_extract_all(lower({}), '[\\pL\\pN]+')"


@_query(f"""with {_SENTS}, m as (select item_id::varchar as cid, [case when length(x) > 4 then '[MASK]' else x end for x in {_WORDS.format("text")}] as w from benchmark),
k as (select cid, array_to_string([w[i] for i in range(1, len(w) + 1) if i = 1 or w[i] <> '[MASK]' or w[i - 1] <> '[MASK]'], ' ') as masked_summary from m)
select doc_id || '_' || sent_idx as sid, trim(replace(sent, 'NEWLINE_CHAR', '')) as sentence, masked_summary from sents join k on k.cid = doc_id::varchar""")
def masked_training_rows(spark, d):
    """Sentences joined with the masked summary of the cluster that their id begins with."""
    words = F.transform(T.tokens(F.col("text")), lambda x: F.when(F.length(x) > 4, T.MASK).otherwise(x))
    masks = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("cid"), F.array_join(T.merge_masks(words), " ").alias("masked_summary"))
    scored = _sents(spark, d).join(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id", "left_semi").select(T.sid(F.col("doc_id"), F.col("sent_idx")).alias("sid"), F.col("sent").alias("sentence"))
    return assemble.training_rows(scored, masks).select("sid", "sentence", "masked_summary")


@_query("""with t as (select conv_id, list(text order by turn) as l from conversations where role = 'user' group by conv_id), m as (select item_id as cluster_id, unnest([0, 1, 2]) as pos, item_id + unnest([0, 7, 1000000]) as conv_id from benchmark)
select cluster_id, coalesce(string_agg(case when l[1] <> '' then l[1] end, ' ' order by pos), '') as query from m left join t using (conv_id) group by cluster_id""")
def member_query_join(spark, d):
    """The first questions of a sample's conversations; missing ones are skipped."""
    first = table(spark, d, "conversations").where("role = 'user'").groupBy(F.col("conv_id").alias("doc_id")).agg(F.min_by("text", "turn").alias("query"))
    members = table(spark, d, "benchmark").select(F.col("item_id").alias("cluster_id"), F.posexplode(F.array(F.col("item_id"), F.col("item_id") + 7, F.col("item_id") + 1000000)).alias("pos", "doc_id"))
    return assemble.member_queries(members, first)


@_query(f"with {_QS.replace(', qt as', ', unused as')}, h as (select source || '_' || doc_id as did, source, text[1:20] as headline from documents) select cid, min(query) as query, count(did) as n, coalesce(string_agg(headline, '|' order by did), '') as headlines from qs left join h on starts_with(did, cid || '_') group by cid")
def trigger_assembly(spark, d):
    """A query with the headlines of all documents whose ids begin with its cluster's."""
    heads = table(spark, d, "documents").select(F.concat_ws("_", "source", F.col("doc_id").cast("string")).alias("did"), F.substring("text", 1, 20).alias("headline"))
    rows = assemble.triggers(cluster_queries(spark, d).withColumn("cid", F.concat("cid", F.lit("_"))), heads)
    return rows.select(F.rtrim(F.col("cid"), F.lit("_")).alias("cid"), "query", F.size("headlines").cast("long").alias("n"), F.array_join(F.map_values("headlines"), "|").alias("headlines"))


@_query(f"with {_QS.replace(', qt as', ', unused as')}, h as (select source || '_' || doc_id as did, text[1:20] as headline from documents) select cid, query, did, headline from qs left join h on starts_with(did, cid || '_')")
def trigger_rows(spark, d):
    """The same a row for each headline."""
    heads = table(spark, d, "documents").select(F.concat_ws("_", "source", F.col("doc_id").cast("string")).alias("did"), F.substring("text", 1, 20).alias("headline"))
    rows = assemble.trigger_rows(cluster_queries(spark, d).withColumn("cid", F.concat("cid", F.lit("_"))), heads)
    return rows.select(F.rtrim(F.col("cid"), F.lit("_")).alias("cid"), "query", "did", "headline")


@_query("""with r as (select c_custkey, o_orderkey, o_orderdate, o_orderpriority as p from orders join customer on o_custkey = c_custkey), g as (select *, lag(p) over (partition by c_custkey order by o_orderdate, o_orderkey) as q from r)
select c_custkey, o_orderkey, (sum(case when q is null or q <> p then 1 else 0 end) over (partition by c_custkey order by o_orderdate, o_orderkey) - 1)::bigint as "group" from g""")
def group_boundaries(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate", "o_orderpriority")
    return assemble.group_numbers(rows, "c_custkey", ["o_orderdate", "o_orderkey"], ["o_orderpriority"]).select("c_custkey", "o_orderkey", "group")


@_query(f"""with v as (select unnest({_WORDS.format("text")}) as token from benchmark), k as (select token, row_number() over (order by token)::int as id from (select distinct token from v)),
q as (select conv_id, turn, unnest(w) as token, unnest(range(1, len(w) + 1)) as pos from (select conv_id, turn, {_WORDS.format("text")} as w from conversations where role = 'user'))
select c.conv_id || '_' || c.turn as uid, coalesce(string_agg(case when q.token is not null then coalesce(id, 100000)::varchar end, ' ' order by pos), '') as ids from (select conv_id, turn from conversations where role = 'user') c left join q using (conv_id, turn) left join k using (token) group by all""")
def words_to_ids(spark, d):
    vocabulary = assemble.vocabulary(table(spark, d, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("token")))
    rows = table(spark, d, "conversations").where("role = 'user'").select(T.sid(F.col("conv_id"), F.col("turn")).alias("uid"), T.tokens(F.col("text")).alias("words"))
    return assemble.token_ids(rows, vocabulary, "uid", 100000).select("uid", F.array_join("ids", " ").alias("ids"))


@_query("select vec_id || '_' || (i - 1) as sid, embedding[i]::double as score from embeddings, unnest(range(1, label % 16 + 1)) as u(i)")
def score_termination(spark, d):
    """Scores up to the first -inf, which stands for padding from the place that the label says."""
    inf = F.lit(float("-inf"))
    padded = F.transform("embedding", lambda x, i: F.when(i < F.col("label") % 16, x.cast("double")).otherwise(inf))
    return table(spark, d, "embeddings").select(F.explode(score.terminated(padded, F.col("vec_id"))).alias("s")).select("s.sid", "s.score")


@_query("with e as (select user_id, event_id, tanh(sqrt(greatest(value, 0))) as v from events where value is not null), t as (select user_id, sum(v) as t from e group by user_id) select user_id, event_id, round(coalesce(v / nullif(t, 0), 0), 6) as score from e join t using (user_id)")
def l1_squashed(spark, d):
    return rank.l1(table(spark, d, "events").where("value is not null"), "user_id", "value", squash=True).select("user_id", "event_id", F.round("normed", 6).alias("score"))


@_query("""with e as (select user_id, event_id, (round(value * 100))::bigint as a, event_id % 17 as b from events where value is not null), t as (select user_id, sum(greatest(a, 0)) as ta, sum(b) as tb from e group by user_id)
select event_id, round(0.8::double * coalesce(greatest(a, 0)::double / nullif(ta, 0), 0) + (1 - 0.8::double) * coalesce(b::double / nullif(tb, 0), 0), 6) as score from e join t using (user_id)""")
def interpolate_scaled(spark, d):
    rows = table(spark, d, "events").where("value is not null").select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("a"), (F.col("event_id") % 17).alias("b"))
    first, second = (rows.select("user_id", "event_id", F.col(c).alias("score")) for c in "ab")
    return rank.interpolated(first, second, ["user_id", "event_id"], 0.8, scaled_by="user_id").select("event_id", F.round("score", 6).alias("score"))


@_query(_BEST + f", tgts as {_TARGET.split('tgts as ')[1]}, src as (select cid, string_agg(sent, ' ' order by rank) as src from best group by cid) select cid, {_TOKEN} || query || ' [SEP] ' || src as src, tgt from src join tgts using (cid) join qs using (cid)")
def generator_rows_with_query(spark, d):
    return assemble.generator_rows(assemble.sources(_best(spark, d), "rank"), _targets(spark, d), queries=cluster_queries(spark, d))


@_query("select conv_id, trim(l[1]) || '.' as title, array_to_string(l[2:], ' ') as narr, trim(l[1]) || '.' || case when len(l) > 1 and array_to_string(l[2:], ' ') <> '' then ' ' || array_to_string(l[2:], ' ') else '' end as query from (select conv_id, list(text order by turn) as l from conversations where role = 'user' group by conv_id)")
def raw_query_text(spark, d):
    turns = table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("l"))
    return turns.select("conv_id", *[T.raw_query(F.col("l"), k).alias(n) for k, n in (("TITLE", "title"), ("NARR", "narr"), ("QUERY", "query"))])


@_query(f"with p as (select source as cid, doc_id as pid, {_WORDS.format('text')} as w from documents), {_QS}, t as (select cid, pid, term, count(*) as tf from (select cid, pid, unnest(w) as term from p) group by all), n as (select cid, pid, sum(tf * tf) as s from t group by all), z as (select cid, sum(qtf * qtf) as z from qt group by cid), k as (select cid, pid, sum(tf * qtf) as dot from t join qt using (cid, term) group by all)\nselect cid, pid, round(coalesce(dot::double / nullif(sqrt(s::double * z), 0), 0), 6) as score from p join z using (cid) left join n using (cid, pid) left join k using (cid, pid)")
def passage_relevance(spark, d):
    return score.passage_scores(documents(spark, d).select("cid", F.col("doc_id").alias("pid"), "text"), cluster_queries(spark, d))


@_query(f"with {_SENTS}, f as (select * from sents where not contains(sent, '``') and len({_WORDS.format('sent')}) >= 3) select doc_id, count(*) as n_sents, string_agg(trim(lower(sent)), '|' order by sent_idx) as proc from f group by doc_id")
def processed_paragraphs(spark, d):
    """Documents as paragraphs of their sentences, those kept whose processed form isn't empty."""
    pairs = T.processed_paragraph(T.split_sentences(F.col("text")), min_words=3, drop_dialogue=True)
    found = lambda p: F.struct(F.size(p).cast("long").alias("n_sents"), F.array_join(F.transform(p, lambda x: x["proc"]), "|").alias("proc"))
    # a row of its own, so that neither the filter nor the two columns make the sentences again
    return documents(spark, d).select("doc_id", F.explode(F.array(T.bound(pairs, found))).alias("p")).select("doc_id", "p.*").where("n_sents > 0")


@_query(_PAIRS + _MET.format(extra="") + ", b as (select cid, i, j, sim from sims union all select cid, j, i, sim from sims), r as (select *, coalesce(sum(sim) over (partition by cid, i order by sim desc, j rows between unbounded preceding and 1 preceding), 0) as before, sum(sim) over (partition by cid, i) as t from b) select cid, i, j from r where before < t * 0.4::double")
def sim_massed(spark, d):
    s = sim_pairs_cosine(spark, d)
    both = s.unionByName(s.select("cid", F.col("j").alias("i"), F.col("i").alias("j"), "sim"))
    return score.massed(both, 0.4).select("cid", "i", "j")


@_query(_BM25_PAIRS + ", r as (select cid, i, j, sim, (round(greatest(sim, 0) * 1000000))::bigint as u from sims), s as (select cid, i, j, coalesce(sum(u) over (partition by cid, i order by sim desc, j rows between unbounded preceding and 1 preceding), 0) as before, sum(u) over (partition by cid, i) as t from r) select cid, i, j from s where t <= 0 or 2 * before < t")
def sim_massed_bm25(spark, d):
    """Of the BM25 scores of a sentence for all others of its cluster the best that hold half of their sum."""
    rows = score.bm25_pairs(_head(spark, d)).withColumn("u", F.round(F.greatest("sim", F.lit(0.0)) * 1000000).cast("long")).withColumn("node", F.struct("cid", "i"))
    return rank.confident(rank.ranked(rows, "node", "j", score="sim", bounded=True), 0.5, "node", value="u", bounded=True).select("cid", "i", "j")


@_query("with l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1:2] as p from documents) select doc_id, i - 1 as para_idx, p[i] as para from l, unnest(range(1, len(p) + 1)) as u(i)")
def paragraph_head_limit(spark, d):
    """The first two paragraphs of every document."""
    return tables.paragraphs(documents(spark, d), "\n", 2).select("doc_id", *_long("para_idx"), "para")


@_query()
def stemmed_rouge(spark, d):
    """Sentence ROUGE on stems."""
    sents = _sents(spark, d).select("cid", "doc_id", *_long("sent_idx"), T.tokens(F.col("sent")).alias("words"))
    refs = references(spark, d).where("ref_idx = 0").select("cid", "ref_idx", T.tokens(F.col("text")).alias("words"))
    return rouge.scores(sents, refs, ["cid", "doc_id", "sent_idx"], 1, stem=True).select("cid", "doc_id", "sent_idx", "overlap", "f1")


@_query(f"""with {_HEAD}, {_SUMMARIES.replace(_REFS + ", ", "")}, words as (select cid, i, regexp_extract_all(lower(sent), '[\\pL\\pN]+') as w from head where i < 30),
kept as (select cid, k, flatten(list(w order by i)) as w from words, range(1, 31) as u(k) where i < k group by cid, k),
texts as (select c.cid, u.k as doc_id, 0 as sent_idx, coalesce(w, []) as w from (select distinct cid from summaries) c, range(1, 31) as u(k) left join kept on kept.cid = c.cid and kept.k = u.k), {_rouge_sql(2, refs="ref_idx >= 0")},
each_ as (select doc_id as var, cid, avg(recall) as recall, avg(f1) as f1 from rouge group by all) select var::double as var, round(avg(recall), 6) as recall, round(avg(f1), 6) as f1 from each_ group by var""")
def tune_topk(spark, d):
    """A tuning curve: ROUGE-2 of the sentences that each length of the list keeps."""
    refs = references(spark, d).select("cid", "ref_idx", T.tokens(F.col("text")).alias("words"))
    return drivers.tuned(_top(spark, d, 30), refs, "topK", rank.FINE)


def _system(spark, d):
    """Each cluster's best sentences, and all references."""
    own = F.sort_array(F.collect_list(F.struct("rank", "words")))
    texts = _top(spark, d, 30).groupBy("cid").agg(F.flatten(F.transform(own, lambda x: x["words"])).alias("words"))
    refs = references(spark, d).select("cid", "ref_idx", T.tokens(F.col("text")).alias("words"))
    return texts, refs


@_query()
def system_scores(spark, d):
    """The first 250 words of each cluster's best sentences against all references, by stems: ROUGE-1, -2, -SU4 and -L."""
    return rouge.system_score(*_system(spark, d), (1, 2, "su4", "l"), stem=True)


@_query()
def system_intervals(spark, d):
    """The same scores with the bounds that 95 percent of 1,000 resamples of the clusters lie in."""
    scores = rouge.cluster_scores(*_system(spark, d), (1, 2, "su4", "l"), stem=True)
    return rouge.bootstrap(scores, F.col("cid"), ["n"], ["recall", "f1"])


@_query()
def random_mask_ablation(spark, d):
    """As many words of each summary as a share of 0.3 of it, drawn by a hash."""
    words = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("cid"), F.size(T.tokens(F.col("text"))).alias("n"), F.posexplode(T.tokens(F.col("text"))).alias("i", "word"))
    return mask.random_mask(words, F.floor(F.col("n") * 0.3)).select("cid", *_long("i"), "word")
