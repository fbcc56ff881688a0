"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, jaccard, language, mixing, neighbours, pii, quality, repeats, urls, warc
from quillon.llm.common import held_out, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), train=~held_out("doc_id"))
    return quality.score(docs, model)


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "items")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language.fit(docs, train=~held_out("id"))
    out = language.predict(docs.withColumn("doc_id", F.col("doc_id").cast("long")), profiles, keep=("doc_id",))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.deduplicate(table(spark, sf_dir, "documents")).drop("kept")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derivatives of every page's response; n_bytes is the record block's length."""
    return warc.digests(warc.derive(warc.from_pages(table(spark, sf_dir, "pages")), keep=("page_id",)))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).drop("ratio")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_jaccard, op3_neighbours, op4_decontaminate, op5_mixing, op6_language, op7_repeats, op8_warc, op9_pii, op10_urls)}
SQL: dict[str, str] = {}

SQL["op5_mixing"] = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) size, md5(doc_id::varchar) turn from documents),
s as (select source, sum(size)::bigint source_size from d group by source),
r as (select *, row_number() over (order by source is null, source) rank, ((row_number() over (order by source is null, source) - 1) % 3 + 1)::double weight, 3.0::double * source_size cap, count(*) over () n from s),
l as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0))
  / (sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0)) as lvl from r),
t as (select source, source_size, case when cap <= weight * lvl then cap else least(cap, weight * max(case when cap > weight * lvl then lvl end) over ()) end target,
  case when n > 1 then 0.8::double * (2.0::double * (rank - 1) / (n - 1) - 1) else 0 end slope from l),
o as (select d.*, t.source_size, t.target, t.slope, round(t.target)::bigint whole,
  coalesce(sum(size) over (partition by d.source order by turn, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint before from d join t on d.source is not distinct from t.source),
f as (select *, case when source_size > 0 then whole // source_size else 0 end passes, least(greatest(before / greatest(target, 1.0::double), 0), 1) share from o)
select doc_id, size, source_size, target, (passes * size + greatest(0, least(size, whole - passes * source_size - before)))::bigint taken,
  round(2 * share / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * share)), 6) as position from f
"""

_UUID = "'<urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || '>'"
_DECODED = "t"
for _name, _char in warc.ENTITIES:
    _DECODED = f"replace({_DECODED}, '{_name}', chr({ord(_char)}))"
SQL["op8_warc"] = rf"""
with p as (select page_id, coalesce(url, '') u, coalesce(html, '') html from pages),
r as (select *, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html as blk, 'sha256:' || sha256(html) payload from p),
i as (select *, md5('response ' || page_id || ' ' || u || ' sha256:' || sha256(blk)) h from r),
f as (select page_id, u, {_UUID} src, html, blk, payload from i),
t0 as (select *, regexp_replace(html, '<!--.*?-->', ' ', 'gs') t from f),
t1 as (select * replace (regexp_replace(regexp_replace(regexp_replace(t, '<script[^>]*>.*?</script[^>]*>', ' ', 'gsi'), '<style[^>]*>.*?</style[^>]*>', ' ', 'gsi'), '[ \t\n\x0B\f\r]+', ' ', 'g') as t) from t0),
t2 as (select * replace (regexp_replace(regexp_replace(t, '</?(p|div|br|li|ul|ol|tr|table|h[1-6]|title|head|body|html|nav|footer|header|section|article)\b[^>]*>', chr(10), 'gi'), '<[^>]*>', '', 'g') as t) from t1),
t3 as (select * replace ({_DECODED} as t) from t2),
t4 as (select * replace (regexp_replace(regexp_replace(regexp_replace(t, '[ \t]*\n[ \t\n]*', chr(10), 'g'), '[ \t]+', ' ', 'g'), '^[ \n]+|[ \n]+$', '', 'g') as t) from t3),
m as (select page_id, u, src, 'conversion' warc_type, 'text/plain; charset=utf-8' content_type, t as made from t4
 union all select page_id, u, src, 'metadata', 'application/warc-fields', 'status: 200' || chr(13) || chr(10) || 'sourceContentType: text/html; charset=utf-8' || chr(13) || chr(10) || 'sourceLength: ' || strlen(blk) || chr(13) || chr(10) || 'sourceDigest: ' || payload || chr(13) || chr(10) || 'title: ' || trim(regexp_replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'si'), '[ \t\n\x0B\f\r]+', ' ', 'g')) || chr(13) || chr(10) || 'outlinks: ' || len(regexp_extract_all(html, '<a\s[^>]*href', 0, 'i')) || chr(13) || chr(10) from t4),
g as (select *, 'sha256:' || sha256(made) block_digest, md5(warc_type || ' ' || src || ' sha256:' || sha256(made)) h from m)
select page_id, warc_type, {_UUID} record_id, u target_uri, src refers_to, content_type, block_digest, strlen(made) n_bytes from g
"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL["op2_jaccard"] = rf"""
with recursive w as materialized (select doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') w from documents),
s as materialized (select distinct doc_id, array_to_string(w[i:i + 4], ' ') g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from w where len(w) > 0)),
n as materialized (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
e as materialized (select a, b from l union all select b, a from l),
r(node, c) as (select doc_id, doc_id from documents union select e.b, r.c from r join e on e.a = r.node where r.c < e.b)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, c.component_id from documents d left join n using (doc_id) join (select node, min(c) component_id from r group by node) c on c.node = d.doc_id
"""
SQL["op4_decontaminate"] = rf"""
with d as materialized (select doc_id, regexp_extract_all({_LOW}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') w from documents),
i as (select item_id::varchar item_id, regexp_extract_all({_LOW}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') w from benchmark),
v as materialized (select distinct item_id, l, array_to_string(w[k:k + l - 1], ' ') g from (select item_id, w, least(len(w), 10) l, unnest(range(1, len(w) - least(len(w), 10) + 2)) k from i where len(w) > 0)),
g as (select doc_id, k, l, array_to_string(w[k:k + l - 1], ' ') g from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) k from d, (select distinct l from v) where len(w) >= l)),
h as materialized (select doc_id, k, g.l, item_id from g join v using (l, g)),
x as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(k, k + l)) p from h) group by doc_id),
y as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) items from (select distinct doc_id, item_id from h) group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated from d left join x using (doc_id) left join y using (doc_id)
"""
SQL["op7_repeats"] = r"""
with d as materialized (select doc_id, hex(encode(coalesce(text, ''))) h, strlen(coalesce(text, '')) n from documents),
p as (select doc_id, i, substr(h, 2 * i + 1, 200) s from (select doc_id, h, unnest(range(0, n - 99)) i from d where n >= 100)),
m as materialized (select doc_id, i from p qualify row_number() over (partition by s order by doc_id, i) > 1),
b as (select doc_id, i, case when i > lag(i) over (partition by doc_id order by i) + 100 then 1 else 0 end fresh from m),
r as materialized (select doc_id, run, min(i) a, max(i) + 100 z from (select doc_id, i, sum(fresh) over (partition by doc_id order by i) run from b) group by all),
k as (select doc_id, count(*) n_spans, sum(z - a) n_removed, max(z) last, string_agg(substr(h, 2 * coalesce(before, 0) + 1, 2 * (a - coalesce(before, 0))), '' order by a) kept from (select r.*, h, lag(z) over (partition by doc_id order by a) before from r join d using (doc_id)) group by doc_id)
select doc_id, n::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans, sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) kept_sha256 from d left join k using (doc_id)
"""
