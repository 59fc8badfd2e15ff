"""The queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symquarry.llm import ann, decontaminate, line_dedup, mixing, quality, secrets, sharding, simhash, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_digest(secrets.secrets(_table(spark, sf_dir, "documents")))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination_digest(found)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    coefficients = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, coefficients, site=F.col("source"), section=F.col("lang"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_neighbours, op3_toxicity, op4_sharding, op5_simhash, op6_secrets, op7_lines, op8_decontaminate, op9_warc, op10_quality,
    )
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Kinds of spans: number, name, pattern, the group whose length counts and its least length.
_SPANS = r"""(values (0, 'assign', '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  (1, 'access', 'AKIA[A-Z0-9]+', 0, 20), (2, 'hex', '[0-9a-f]+', 0, 24), (3, 'entropy', '[A-Za-z0-9+/_=-]+', 0, 20)) as p(k, kind, pattern, grp, least)"""
#: Bits a character of the window x.
_BITS = "list_sum(list_transform(map_values(list_histogram(string_split(x, ''))), lambda n: -(n / 20.0) * log2(n / 20.0)))"
_BASE32 = f"'{_UPPER}234567'[((('0x' || substr(sha1(payload), (5 * j // 4 + 1)::int, 2))::int >> (3 - 5 * j % 4)::int) & 31) + 1]"

#: DuckDB SQL for the operators that it can express: exact results that need no learned or seeded part.
ORACLE_SQL: dict[str, str] = {
    "op1_mixing": r"""
with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
  ('0x' || substr(md5('7:' || coalesce(doc_id::varchar, '')), 1, 12))::bigint as h from documents),
sources as (select source, sum(size)::bigint as n, 3.0::double * sum(size)::double as cap, [1, 2, 3][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w from sized group by source),
-- The sources with the least caps for their weights are clamped until no share is above its cap.
turns as (select *, row_number() over (order by cap / w, source nulls last) as k, coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as clamped,
  sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as left_w, sum(n) over () as total from sources),
level as (select coalesce((select (total - clamped) / left_w from turns where (total - clamped) / left_w * w < cap order by k limit 1), 1e300) as x),
plan as (select source, n, least(x * w, cap)::double as target, case when n > 0 then floor(least(x * w, cap) / n) else 0 end::bigint as whole from sources, level),
needs as (select *, target - whole * n as need from plan),
-- In the order of the hash each document that fits the gap is taken; one that overshoots sets the limit for those behind it.
queues as (select p.source, target, need, list({'g': need, 'l': need, 'o': need > 0, 'c': 0.001 * target, 's': size, 't': []::bigint[]} order by h, doc_id) as q, list(doc_id order by h, doc_id) as ids, list(size order by h, doc_id) as sizes
  from needs p join sized d on d.source is not distinct from p.source and size > 0 group by all),
runs as (select *, list_reduce(q, lambda a, x: case
    when not a.o or x.s > a.l then {'g': a.g, 'l': a.l, 'o': a.o, 'c': a.c, 's': x.s, 't': list_append(a.t, 0::bigint)}
    when x.s <= a.g then {'g': a.g - x.s, 'l': a.l, 'o': a.o, 'c': a.c, 's': x.s, 't': list_append(a.t, 1::bigint)}
    else {'g': a.g, 'l': a.g, 'o': a.g > a.c, 'c': a.c, 's': x.s, 't': list_append(a.t, 0::bigint)} end,
    {'g': need, 'l': need, 'o': need > 0, 'c': 0.001 * target, 's': 0::bigint, 't': []::bigint[]}) as r from queues),
each as (select source, r.g as gap, unnest(ids) as doc_id, unnest(sizes) as size, unnest(r.t) as t, unnest(range(1, len(ids) + 1)) as i from runs),
extra as (select source, arg_min(doc_id, (size, i)) as doc_id from each where t = 0 and size < 2 * gap group by source)
select d.doc_id, d.size, n as source_size, target, (case when d.size = 0 then 0 else (whole + t + (x.doc_id is not null)::int) * d.size end)::bigint as taken
from sized d join needs p on p.source is not distinct from d.source left join each e on e.doc_id = d.doc_id and e.source is not distinct from d.source
  left join extra x on x.doc_id = d.doc_id and x.source is not distinct from d.source""",
    "op6_secrets": rf"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
m as (select r, k, kind, least, regexp_extract_all(t, pattern) as f, regexp_extract_all(t, pattern, grp) as v, string_split_regex(t, pattern) as g from t, {_SPANS}),
e as (select r, k, kind, least, f, v, g, unnest(range(1, len(f) + 1)) as i from m),
s as (select r, k, kind, f[i] as found, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0))::bigint as b
  from e where length(v[i]) >= least),
spans as (select r, k, kind, found, b, b + length(found) as e from s),
candidates as (select *, regexp_full_match(found, '[0-9a-fA-F]+') as is_hex from spans c where k = 3
  and not regexp_matches(found, '^[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$|^[0-9+/_=-]+$|(?i:EXAMPLE(KEY)?$)')
  and regexp_matches(regexp_replace(found, '[A-Z]?[a-z]{{2,}}|[A-Z]{{3,}}', '/', 'g'), '[0-9]|[A-Za-z]{{2}}')
  and not exists (select 1 from spans x where x.r = c.r and x.k < 3 and x.b <= c.b and x.e >= c.e)),
windows as (select r, b, is_hex, unnest(list_transform(range(1, length(found) - 18), lambda i: substr(case when is_hex then lower(found) else found end, i, 20))) as x from candidates),
found as (select r, b from windows group by r, b having max({_BITS}) >= (case when bool_or(is_hex) then 3.0 else 3.8 end)),
kept as (select * from spans where k < 3 union all select s.* from spans s semi join found f on f.r = s.r and f.b = s.b and s.k = 3),
listed as (select r, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
  string_agg(kind || ':' || b || ':' || e, ',' order by b, k) filter (k < 3) as base, string_agg(kind || ':' || b || ':' || e, ',' order by b, k) as every from kept group by r)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(every, '') as spans from t left join listed l on l.r = t.r""",
    "op8_decontaminate": f"""
with items as (select item_id::varchar as item, w from (select item_id, {_WORDS} as w from benchmark) where len(w) > 0),
windows as (select distinct item, least(len(w), 10) as size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as phrase
  from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from items)),
docs as (select doc_id, {_WORDS} as w from documents),
spots as (select doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') as phrase
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from docs, (select distinct size from windows))),
hits as (select doc_id, i, s.size, item from spots s join windows x on x.size = s.size and x.phrase = s.phrase),
covered as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + size)) as k from hits) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs d left join covered c on c.doc_id = d.doc_id left join found f on f.doc_id = d.doc_id""",
    "op9_warc": f"""
with p as (select page_id, coalesce(html, '') as payload from pages),
d as (select *, min(page_id) over (partition by payload) as first, array_to_string(list_transform(range(32), lambda j: {_BASE32}), '') as digest from p)
select page_id, strlen(payload)::bigint as payload_bytes, digest as payload_digest,
  case when first = page_id then 'response' else 'revisit' end as record_type, case when first = page_id then null else first end as refers_to from d""",
}
