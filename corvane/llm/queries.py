"""The queries opN_<name> and pipeline, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from corvane.llm import bands, best_fit, divergence, exact_dedup, langid, mixing, packing, secrets, sharding, simhash, syncmers, tokens, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.report(_documents(spark, sf_dir))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(_documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_documents(spark, sf_dir))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.report(_documents(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(_documents(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(_documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(_documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_documents(spark, sf_dir))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(_documents(spark, sf_dir))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_documents(spark, sf_dir))


def op13_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.near_prices(spark.read.parquet(f"{sf_dir}/sale_lines.parquet"), spark.read.parquet(f"{sf_dir}/items.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


OP7_SQL = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = max(doc_id) over g as kept, sha256(t) as text_sha256
from (select doc_id, coalesce(text, '') as t from documents)
window g as (partition by t)
"""


OP4_SQL = r"""
with sizes as materialized (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
per as (select source, sum(size)::bigint as z, count(*) as n from sizes group by source),
ranked as (select *, row_number() over (order by source nulls last) - 1 as rank from per),
weighed as (select *, [3, 1, 2][(rank % 3 + 1)::int] as w, 2 * z as cap, sum(z) over () * 1.5::double as total from ranked),
levels as (
  select *, total - coalesce(sum(cap) over b, 0) as left_, sum(w) over () - coalesce(sum(w) over b, 0) as w_left
  from weighed window b as (order by cap / w, rank rows between unbounded preceding and 1 preceding)),
level as (select left_ as l, w_left as wl from levels where cap * w_left > left_ * w order by cap / w, rank limit 1),
target as (
  select source, rank, n, z, w, cap, case when cap * w_left <= left_ * w then cap::double else w * (select l from level) / (select wl from level) end as target
  from levels),
sized as (
  select *, ceil(n / 4096.0)::bigint as shards, greatest(1, least(2048, floor(coalesce(
    (select min(least(target / 200, z / (ceil(n / 4096.0)::bigint * 64)::double)) from target where target > 0), 0))))::bigint as block from target),
seats as (select *, floor((select sum(target) from target) / block + 0.5)::bigint as seats from sized),
quota as (
  select rank, count(*) as quota from (
    select rank, row_number() over (order by target / (2 * s - 1) desc, rank, s) as place, seats
    from (select rank, target, seats, unnest(range(1, seats + 1)) as s from seats where target > 0))
  where place <= seats group by rank),
placed as (
  select s.doc_id, s.size, t.rank, t.z, t.target, t.block, coalesce(q.quota, 0) as quota,
         ('0x' || substr(md5('mix-1/shard' || chr(1) || coalesce(s.doc_id::varchar, '') || chr(1) || s.size::varchar), 1, 12))::bigint % t.shards as shard,
         ('0x' || substr(md5('mix-1/order' || chr(1) || coalesce(s.doc_id::varchar, '') || chr(1) || s.size::varchar), 1, 12))::bigint as line
  from sizes s join seats t on s.source is not distinct from t.source left join quota q on q.rank = t.rank),
shard as (select rank, shard, quota, block, sum(size)::bigint as size from placed group by all),
shard_quota as (
  select rank, shard, count(*) as blocks from (
    select rank, shard, quota, row_number() over (partition by rank order by size / (2 * s - 1) desc, shard, s) as place
    from (select rank, shard, quota, size, unnest(range(1, quota + 1)) as s from shard where size > 0))
  where place <= quota group by all),
passes as (
  select *, words // n as passes, words % n as rest, (words % n + block - 1) // block as q,
         ('0x' || substr(md5('mix-1/phase' || chr(1) || rank::varchar || chr(1) || shard::varchar), 1, 12))::bigint % n as phase
  from (select s.rank, s.shard, s.block, greatest(s.size, 1) as n, least(coalesce(blocks, 0) * s.block, 2 * s.size)::bigint as words
        from shard s left join shard_quota q on q.rank = s.rank and q.shard = s.shard)),
lined as (
  select p.*, s.n, s.passes, s.rest, s.q, s.phase + (sum(size) over (partition by p.rank, p.shard order by line, doc_id rows between unbounded preceding and current row))::bigint - size as b
  from placed p join passes s on p.rank = s.rank and p.shard = s.shard),
ends as (
  select *, n // greatest(q, 1) as wide, n % greatest(q, 1) as more, list_transform([b, b + size], lambda y: {'rounds': y // n, 'x': y % n}) as at_ from lined),
cut as (
  select *, list_transform(at_, lambda p: {'rounds': p.rounds, 'x': p.x,
    'k': case when p.x < more * (wide + 1) then p.x // (wide + 1) else more + (p.x - more * (wide + 1)) // greatest(wide, 1) end}) as cut_ from ends),
before as (
  select *, list_transform(cut_, lambda p: p.rounds * rest + p.k * (rest // greatest(q, 1)) + least(p.k, rest % greatest(q, 1))
    + least(p.x - p.k * wide - least(p.k, more), rest // greatest(q, 1) + (p.k < rest % greatest(q, 1))::int)) as w from cut)
select doc_id, size, z as source_size, round(target, 6) as target, (passes * size + case when q > 0 then w[2] - w[1] else 0 end)::bigint as taken
from before
"""


def _op10_sql() -> str:
    """The spans of every kind as rows, weak ones kept where a part of another role is near."""
    every = secrets.BASE | secrets.WEAK
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    kinds = ", ".join(f"({no}, {quoted(k)}, {quoted(part)}, {least})" for no, (k, (_, _, least, part)) in enumerate(every.items()))
    found = " union all ".join(
        f"""select doc_id, {no} as no, regexp_extract_all(t, {quoted(pattern)}) as m, regexp_extract_all(t, {quoted(pattern)}, {group}) as c, string_split_regex(t, {quoted(pattern)}) as gaps from docs"""
        for no, (pattern, group, _, _) in enumerate(every.values())
    )
    return f"""
with docs as (select doc_id, coalesce(text, '') as t from documents),
kinds(no, kind, part, least) as (values {kinds}),
found as ({found}),
placed as (
  select doc_id, no, length(c[i]) as n, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as start_, length(m[i]) as size
  from (select *, unnest(range(1, len(m) + 1)) as i from found)),
spans as (select p.doc_id, p.no, k.kind, k.part, start_::bigint as s, (start_ + size)::bigint as e, p.no < {len(secrets.BASE)} as base from placed p join kinds k on k.no = p.no where p.n >= k.least),
apart as (select * from spans w where base or part <> 'secret' or not exists (select 1 from spans b where b.base and b.doc_id = w.doc_id and b.s < w.e and b.e > w.s)),
linked as (
  select * from apart w where base or exists (
    select 1 from apart o where o.doc_id = w.doc_id and (o.part = 'secret') <> (w.part = 'secret') and o.s < w.e + {secrets.REACH} and o.e > w.s - {secrets.REACH})),
joined as (
  select doc_id, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' order by s, no) filter (where base) as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, no) as spans
  from linked group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join joined j on j.doc_id = d.doc_id"""


OP12_SQL = r"""
with docs as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
words as (select id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
counted as materialized (select lang, source, term, count(*) as n, count(distinct id) as d from words group by all),
kept as materialized (select lang, term, sum(n)::hugeint as n from counted group by all having sum(d) >= 30),
size as (select lang, count(*)::hugeint as v, sum(n)::hugeint as n from kept group by all),
groups as (
  select g.lang, g.source, coalesce(any_value(s.v), 0)::hugeint as v, coalesce(sum(c.n) filter (where k.term is not null), 0)::hugeint as n
  from (select distinct lang, source from docs) g left join size s on s.lang = g.lang
  left join counted c on c.lang = g.lang and c.source = g.source left join kept k on k.lang = c.lang and k.term = c.term
  group by all),
shares as materialized (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
         1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.n + 5 * g.v) as p, 1 + (1000000000::hugeint * (k.n + 5)) // (s.n + 5 * s.v) as q
  from groups g join kept k on k.lang = g.lang join size s on s.lang = g.lang left join counted c on c.lang = g.lang and c.source = g.source and c.term = k.term),
apart as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join apart x on x.lang = a.lang and x.source = a.source and x.item = b.source),
every as (select * from pairs union all select lang, source, 'term', term, (p - q)::bigint from shares where n > 0 and p > q)
select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from every
qualify part = 'pair' or rank <= 50
"""


#: crc32 is the sum over the text's bytes by a table that the polynomial gives.
OP13_SQL = """
with table_ as materialized (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i::bigint)) as t),
priced as (
  select item_id, case when price is not null and isfinite(price) then floor(100 * price + 0.5)::bigint end as p from items),
read_ as (
  select sale_id, line_no, item_id, quantity::bigint as q, floor(100 * amount + 0.5)::bigint as a from sale_lines
  where sale_id is not null and item_id is not null and quantity <> 0 and amount is not null and isfinite(amount)),
lined as materialized (
  select sale_id, line_no, item_id as line_item_id,
         ((2 * a + q) * sign(q) - (((2 * a + q) * sign(q)) % (2 * abs(q)) + 2 * abs(q)) % (2 * abs(q)))::bigint // (2 * abs(q))::bigint as u,
         xor(list_reduce(list_transform(string_split(concat_ws(',', sale_id, line_no, item_id), ''), lambda ch: ord(ch)::bigint),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295) as crc
  from read_, table_),
numbered as (select row_number() over () as id, item_id, p from priced),
pairs as (
  select id, abs(u - p) as gap, u, sale_id, line_no, line_item_id, crc
  from numbered i join lined l on u between least(p - 50, (1000 * p) // 1005 - 1) and greatest(p + 50, (1005 * p) // 1000 + 1)
  where l.line_item_id is distinct from i.item_id and (abs(u - p) <= 50 or 1000 * abs(u - p) <= 5 * least(u, p))),
totals as (select id, count(*) as n_pairs, sum(gap)::bigint as gap_sum, sum(crc)::bigint as lines_crc from pairs group by id),
ranked as (select *, row_number() over (partition by id order by gap, u, sale_id, line_no nulls first, line_item_id) as rank from pairs qualify rank <= 10)
select i.item_id, coalesce(r.rank, 0)::int as rank, r.gap::bigint as gap, r.u::bigint as u, r.sale_id::bigint as sale_id, r.line_no::bigint as line_no, r.line_item_id::bigint as line_item_id,
       coalesce(t.n_pairs, 0)::bigint as n_pairs, coalesce(t.gap_sum, 0)::bigint as gap_sum, coalesce(t.lines_crc, 0)::bigint as lines_crc
from numbered i left join totals t on t.id = i.id left join ranked r on r.id = i.id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_language": op2_language,
        "op3_toxicity": op3_toxicity,
        "op4_mixing": op4_mixing,
        "op5_fingerprints": op5_fingerprints,
        "op6_sharding": op6_sharding,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_simhash": op8_simhash,
        "op9_packing": op9_packing,
        "op10_secrets": op10_secrets,
        "op11_best_fit": op11_best_fit,
        "op12_divergence": op12_divergence,
        "op13_band_join": op13_band_join,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": OP4_SQL, "op7_exact_dedup": OP7_SQL, "op10_secrets": _op10_sql(), "op12_divergence": OP12_SQL, "op13_band_join": OP13_SQL}
