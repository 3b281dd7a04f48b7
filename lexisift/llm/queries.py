"""The operators as queries over the tables of a folder, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexisift.llm import archives, collocations, compression, decontaminate, html_text, minhash, mixing, periodic, quality, sentencepieces, substrings, token_counts, toxicity
from lexisift.llm import pipeline as corpus
from lexisift.llm.shared import importable, table, tokenizer_path


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archived(table(spark, sf_dir, "pages"), version=2, least_bytes=0).drop("target_uri")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), modulus=4, held=2, threshold=0.3)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compression_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), modulus=5, held=0, threshold=0.3)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encoded_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), limit=2048)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(table(spark, sf_dir, "documents"), width=35)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return periodic.run_digests(periodic.periodic_runs(docs.select("doc_id", periodic.planted(docs.text, docs.doc_id).alias("text")), power=4, least=6))


def op12_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), share=(3, 2), most=2).drop("source")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), longest=3, least=10, inside=50, top=2000)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.run(spark, sf_dir)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACES = "'[\\x20\\x09-\\x0D]+'"

OP1_SQL = f"""
with recursive words as (select doc_id, list_filter(regexp_split_to_array({_LOWER}, {_SPACES}), lambda x: x <> '') as w from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i:i+2], ' ') as s from words, unnest(range(1, greatest(len(w) - 1, 2))) as u(i) where len(w) > 0),
sets as (select doc_id, count(*) as n, md5(string_agg(s, chr(10) order by s)) as d from shingles group by doc_id),
reps as (select d, min(doc_id) as rep, any_value(n) as n from sets group by d),
own as (select rep, n, s from reps join shingles on doc_id = rep),
pairs as (select a.rep as a, b.rep as b, a.n as an, b.n as bn, count(*) as k from own a join own b on a.s = b.s and a.rep <> b.rep
  and 100 * a.n >= 85 * b.n and 100 * b.n >= 85 * a.n group by all),
links as (select a, b from pairs where 100 * k >= 85 * (an + bn - k)),
reach as (select rep as node, rep as seen from reps union select r.node, l.b from reach r join links l on l.a = r.seen),
least as (select node, min(seen) as component_id from reach group by node)
select w.doc_id, coalesce(s.n, 0)::bigint as n_shingles, coalesce(l.component_id, w.doc_id) as component_id, coalesce(l.component_id, w.doc_id) = w.doc_id as kept
from words w left join sets s using (doc_id) left join reps r using (d) left join least l on l.node = r.rep"""

OP2_SQL = """
with base as (select page_id, coalesce(html, '') as h from pages),
hashed as (select page_id, octet_length(encode(h))::bigint as payload_bytes, sha1(h) as x from base),
bits as (select *, list_transform(range(0, 8), lambda i: list_reduce(list_transform(range(1, 6), lambda j: (strpos('0123456789abcdef', x[5*i+j]) - 1)::bigint), lambda a, b: a * 16 + b)) as c from hashed),
coded as (select page_id, payload_bytes, array_to_string(list_transform(c, lambda v: array_to_string(list_transform([32768, 1024, 32, 1], lambda q: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v // q) % 32) + 1]), '')), '') as payload_digest from bits)
select page_id, payload_bytes, payload_digest, case when page_id = m then 'response' else 'revisit' end as record_type, case when page_id <> m then m end as refers_to
from (select *, min(page_id) over (partition by payload_digest) as m from coded)"""

OP9_SQL = f"""
with items as (select item_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from benchmark),
windows as (select distinct item_id, least(len(w), 10) as k, array_to_string(w[i:i+9], ' ') as g from items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as u(i) where len(w) > 0),
docs as (select doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
sizes as (select distinct k from windows),
found as (select doc_id, i, d.k, item_id from (select doc_id, k, i, array_to_string(w[i:i+k-1], ' ') as g from docs, sizes, unnest(range(1, len(w) - k + 2)) as u(i)) d join windows using (g)),
hits as (select doc_id, count(distinct p) as n_hit from found, unnest(range(i, i + k)) as v(p) group by doc_id),
ids as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as names from (select distinct doc_id, item_id::varchar as x from found) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hits using (doc_id) left join ids using (doc_id)"""

OP10_SQL = f"""
with docs as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), {_SPACES}), lambda x: x <> '') as w from documents),
windows as (select doc_id, i, md5(array_to_string(w[i:i+34], ' ')) as g from docs, unnest(range(1, len(w) - 33)) as u(i)),
repeated as (select doc_id, i from windows join (select g from windows group by g having count(*) > 1) using (g)),
gone as (select distinct doc_id, p from repeated, unnest(range(i, i + 35)) as v(p)),
kept as (select doc_id, string_agg(x, ' ' order by p) as t, count(*) as n from (select doc_id, w[p] as x, p from docs, unnest(range(1, len(w) + 1)) as u(p)) anti join gone using (doc_id, p) group by doc_id)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from docs left join kept using (doc_id)"""

OP11_SQL = f"""
with recursive ids as (select doc_id, coalesce(text, '') as t, list_transform(range(1, len(doc_id::varchar) + 1), lambda i: ascii((doc_id::varchar)[i])::bigint) as b from documents),
crc as (select doc_id, t, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda y, i: xor(y >> 1, (y & 1) * 3988292384)))) as h from ids),
words as (select doc_id, h % 10 = 0 as p10, h // 10 as g, list_filter(regexp_split_to_array(t, {_SPACES}), lambda x: x <> '') as w from crc),
places as (select *, case when p10 and len(w) > 0 then g % len(w) else len(w) end as a from words),
docs as (select doc_id, case when a < len(w) then list_concat(w[1:a], list_transform(range(a, len(w)), lambda i: w[a + (i - a) % (1 + (len(w) - a) // (3 + g % 8)) + 1])) else w end as w from places),
grams as (select doc_id, i, w[i + 1] as g, 1::bigint as k, len(w) as n from docs, unnest(range(len(w))) as u(i) where len(w) >= 4
  union all select * from (select doc_id, i, md5(concat(g, ' ', lead(g, k) over (partition by doc_id order by i))) as g, 2 * k as k, n from grams where 2 * k < n) where i + k <= n),
gaps as (select doc_id, i, k, lead(i) over (partition by doc_id, k, g order by i) - i as q from grams),
squares as (select doc_id, k, q, i, i - row_number() over (partition by doc_id, k, q order by i) as stretch from gaps where q <= k and 2 * q > k),
runs as (select doc_id, min(i) as s, max(i) - min(i) + k + q as n, q from squares group by doc_id, k, q, stretch having n >= greatest(6, 4 * q)),
best as (select doc_id, count(*) as n_runs, max((n, -s, -q)) as m, string_agg(concat(s, ',', n, ',', q, chr(10)), '' order by s, q) as lines from runs group by doc_id),
gone as (select distinct doc_id, p from runs, unnest(range(s + q, s + n)) as u(p)),
kept as (select doc_id, string_agg(x, ' ' order by p) as t from (select doc_id, w[p + 1] as x, p from docs, unnest(range(len(w))) as u(p)) anti join gone using (doc_id, p) group by doc_id)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, -m[2]::bigint as start, m[1]::bigint as length, -m[3]::bigint as period, 1000 * m[1]::bigint // -m[3]::bigint as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(t, '')) as collapsed_sha256
from docs left join best using (doc_id) left join kept using (doc_id)"""

OP12_SQL = f"""
with sized as (select doc_id, source as s, len(list_filter(regexp_split_to_array(coalesce(text, ''), {_SPACES}), lambda x: x <> ''))::bigint as z,
  ('0x' || md5(coalesce(doc_id::varchar, ''))[1:15])::bigint as k from documents),
sources as (select s, sum(z)::bigint as size, [5, 2, 1][((row_number() over (order by s nulls last) - 1) % 3)::int + 1] as w from sized group by s),
ordered as (select *, 3 * sum(size) over () - 4 * coalesce(sum(size) over earlier, 0) as l, sum(w) over () - coalesce(sum(w) over earlier, 0) as r
  from sources window earlier as (order by size::hugeint * 10 / w, s nulls last rows between unbounded preceding and 1 preceding)),
stopped as (select *, l::hugeint * w > r::hugeint * 4 * size as stops from ordered),
freed as (select max((r, l)) as f from stopped where not stops),
known as (select s, size, case when stops then 2 * size::double else (f[2]::hugeint * w)::double / (2 * f[1])::double end as target, (case when stops then 2 * size else f[2]::hugeint * w // (2 * f[1]) end)::bigint as quota from stopped, freed),
placed as (select *, coalesce(sum(z) over (partition by s order by k, doc_id, z rows between unbounded preceding and 1 preceding), 0)::bigint as c from sized)
select doc_id, z as size, size as source_size, target, (greatest(0, least(c + z, quota) - c) + greatest(0, least(size + c + z, quota) - size - c))::bigint as taken
from placed join known on placed.s is not distinct from known.s"""

OP13_SQL = f"""
with pieces as (select lang, row_number() over () as id, w from (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
  lateral (select list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w) where len(w) > 0),
counts as (select lang, m, array_to_string(w[i:i+m-1], ' ') as phrase, count(*)::hugeint as c from pieces, (values (1), (2), (3)) as v(m), unnest(range(1, len(w) - m + 2)) as u(i) group by all),
totals as (select lang, sum(c)::bigint as n from counts where m = 1 group by lang),
candidates as (select lang, m, phrase, c as a, string_split(phrase, ' ') as w from counts where m > 1 and c >= 10),
cuts as (select d.lang, d.phrase, d.a, k, x.c as l, y.c as r, (1000000 * d.a * d.a) // (x.c * y.c) as score
  from (select *, unnest(range(1, m)) as k from candidates) d join counts x on x.lang = d.lang and x.phrase = array_to_string(d.w[1:k], ' ') join counts y on y.lang = d.lang and y.phrase = array_to_string(d.w[k+1:], ' ')),
worst as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
covered as (select lang, phrase, max(a) as around from (select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase from candidates where m = 3) group by all),
left_over as (select worst.* from worst left join covered using (lang, phrase) where around is null or 100 * around < 50 * worst.a)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from left_over) join totals using (lang) where rank <= 2000"""


def _ready(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return query(spark, sf_dir)

    run.__name__ = query.__name__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_minhash_near_dedup, op2_warc, op3_html_extraction, op4_toxicity, op5_quality_classifier, op6_sentencepiece, op7_token_counts, op8_quality_rules, op9_benchmark_decontamination, op10_substring_dedup, op11_periodic_runs, op12_source_mixture, op13_phrase_collocations, pipeline)
    return {q.__name__: _ready(q) for q in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_near_dedup": OP1_SQL,
        "op2_warc": OP2_SQL,
        "op8_quality_rules": quality.quality_sql(),
        "op9_benchmark_decontamination": OP9_SQL,
        "op10_substring_dedup": OP10_SQL,
        "op11_periodic_runs": OP11_SQL,
        "op12_source_mixture": OP12_SQL,
        "op13_phrase_collocations": OP13_SQL,
    }
