"""Registered queries of the corpus operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import decontaminate, jaccard, license_scan, line_dedup, mixing, packing, prefix_trie, pseudonyms, quality_rules, sharding, spelling, token_files, weak_labels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, *tables: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(*(_table(spark, sf_dir, t) for t in tables))
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
JACCARD_SQL = rf"""
with recursive w as (select doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) as w from documents),
s as (select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end)) as s from w),
c as (select s, len(s) as n, min(doc_id) as rep from s where len(s) > 0 group by s),
e as (select rep, n, unnest(s) as t from c),
l as (select a.rep as u, b.rep as v from e a join e b on a.t = b.t and a.rep <> b.rep and 100 * a.n >= 90 * b.n and 100 * b.n >= 90 * a.n
  group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r as (select rep as u, rep as v from c union select r.u, l.v from r join l on r.v = l.u),
m as (select u, min(v) as low from r group by u)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, coalesce(m.low, s.doc_id) as component_id
from s left join c on s.s = c.s left join m on c.rep = m.u"""
CONTAMINATION_SQL = rf"""
with b as (select cast(item_id as varchar) as item, coalesce(regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+'), []) as w from benchmark),
bw as (select item, w, least(13, len(w)) as m, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0),
p as (select distinct item, m, array_to_string(w[i:i + m - 1], ' ') as k from bw),
d as (select doc_id, coalesce(regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+'), []) as w from documents),
x as (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from d, (select distinct m from p) where len(w) >= m),
h as (select x.doc_id, x.i, x.m, p.item from x join p on x.m = p.m and array_to_string(x.w[x.i:x.i + x.m - 1], ' ') = p.k),
n as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + m)) as j from h) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item from h) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n.n_hit, 0) as n_hit, coalesce(t.n_items, 0) as n_items, sha256(coalesce(t.names, '')) as items_sha256,
  coalesce(n.n_hit, 0) > 0 and 20 * coalesce(n.n_hit, 0) >= len(d.w) as contaminated
from d left join n on d.doc_id = n.doc_id left join t on d.doc_id = t.doc_id"""
# crc32 of a list of bytes: one table of 256 remainders, then a byte at a time
_CRC_TABLE = """crc as (select list(v order by i) as t from (select i, list_reduce(list_prepend(i, range(8)),
  lambda x, k: case when (x & 1) = 1 then xor(x >> 1, 3988292384) else x >> 1 end) as v from range(256) r(i)))"""


def _crc(bytes_: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {bytes_}), lambda x, b: xor(x >> 8, crc.t[1 + (xor(x, b) & 255)])), 4294967295)"


_UTF8 = "flatten(list_transform(string_split({}, ''), lambda s: case when unicode(s) < 128 then [cast(unicode(s) as bigint)] else [192 | (unicode(s) >> 6), 128 | (unicode(s) & 63)] end))"
SPELLING_SQL = rf"""
with recursive {_CRC_TABLE},
r as (select coalesce(cast(doc_id as varchar), 'null') as doc, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as text from documents),
w as (select doc, {_LOWER} as w, count(*) as c from r where length(text) >= 7 group by all),
h as (select w, c, {_crc(_UTF8.format("doc || ':' || w"))} as h from w, crc),
t as (select case when h % 31 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as w, c from h),
n as (select w, sum(c)::bigint as n from t where length(w) >= 7 group by w having sum(c) >= 2),
i as (select w, n, unnest(range(1, length(w) + 1)) as i from n),
m as (select w, i, substr(w, 1, i - 1) || '*' || substr(w, i + 1) as k from i),
d as (select distinct w, substr(w, 1, i - 1) || substr(w, i + 1) as k from i),
p as (select a.w as a, b.w as b from m a join m b on a.k = b.k and a.w <> b.w union all select d.w, n.w from d join n on d.k = n.w union all select n.w, d.w from d join n on d.k = n.w),
f as (select p.a as w, count(*) as n_near, min(row(-n.n, p.b)) as best from p join n on p.b = n.w group by p.a),
g as (select n.w, n.n, coalesce(f.n_near, 0) as n_near, case when -f.best[1] >= 10 * n.n then f.best[2] end as form, case when -f.best[1] >= 10 * n.n then -f.best[1] end as form_n from n left join f on n.w = f.w),
q as (select w, w as at_, form as next from g union all select q.w, g.w, g.form from q join g on q.next = g.w)
select g.w as word, g.form, q.at_ as root, g.n, g.n_near, g.form_n from g join q on g.w = q.w and q.next is null"""
TRIE_SQL = f"""
with {_CRC_TABLE},
t as (select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as x,
  row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i from conversations where conv_id is not null),
n as (select c, count(*) as own, c - c % 5 as base from t group by c),
h as (select n.*, {_crc("list_transform(string_split(cast(c as varchar), ''), lambda s: cast(ascii(s) as bigint))")} % 9 as h from n, crc),
g as (select h.c, h.base, h.h, least(h.h, coalesce(b.own, 0)) as given from h left join h b on h.base = b.c),
s as (select t.c, t.i - g.h + g.given as d, t.r, t.x from t join g on t.c = g.c where t.i > g.h union all select g.c, t.i, t.r, t.x from g join t on t.c = g.base and t.i <= g.h),
k as (select c, d, strlen(x) as bytes, string_agg(md5(r) || md5(x), '') over (partition by c order by d) as k, d = max(d) over (partition by c) as ends from s),
p as (select c, d, bytes, k, substr(k, 1, (d - 1) * 64) as up, ends from k union all select c, 0, 0, '', null, c not in (select c from k) from g),
v as (select k, d, any_value(up) as up, min(c) as c, count(*) as n, any_value(bytes) as bytes,
  sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (where ends), '')) as ends_sha256 from p group by k, d),
q as (select up, count(*) as n_children from v group by up),
f as (select v.*, coalesce(q.n_children, 0) as n_children from v left join q on v.k = q.up),
u as (select p.k, sum((f.n_children = 0)::int) as n_leaves, sum((f.n - 1) * f.bytes) as saved from f join p on p.c = f.c and p.d <= f.d group by p.k)
select f.c as conv_id, f.d as depth, b.c as parent_conv_id, f.n as n_convs, f.n_children, cast(u.n_leaves as bigint) as n_leaves, cast(u.saved as bigint) as saved_tokens, f.ends_sha256
from f join u on f.k = u.k left join f b on f.up = b.k"""
MIX_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, md5('mix-1:' || coalesce(cast(doc_id as varchar), 'null')) as digest from documents),
e as (select *, cast('0x' || substr(digest, 1, 8) as bigint) % 24 as shard from d),
a as (select source, sum(size)::double as size, row_number() over (order by source is null, source) - 1 as place from e group by source),
w as (select *, [5, 2, 1][place % 3 + 1] as weight, 1.5::double * sum(size) over () as total from a),
o as (select *, (total - coalesce(sum(2 * size) over (order by size / weight, place rows between unbounded preceding and 1 preceding), 0))
  / sum(weight) over (order by size / weight, place rows between current row and unbounded following) as level from w),
l as (select coalesce(min_by(level, size / weight) filter (where level * weight <= 2 * size), 0) as level from o),
s as (select w.*, least(weight * l.level, 2 * size) as target from w, l),
b as (select greatest(1, floor(coalesce(min(target) filter (where target > 0), 0) / 256))::bigint as block, any_value(total) as total from s),
y as (select place, target / (2 * j - 1) as q from s, (select unnest(range(1, cast(floor(total / block + 0.5) as bigint) + 1)) as j from b) where target > 0),
z as (select place, count(*) as quota from (select place from y order by q desc, place limit (select cast(floor(total / block + 0.5) as bigint) from b)) group by place),
c as (select s.place, e.shard, cast(ceil(sum(e.size) / any_value(block)) as bigint) as blocks from e join s on e.source is not distinct from s.source, b group by s.place, e.shard),
m as (select c.place, least(coalesce(any_value(z.quota), 0), 2 * sum(c.blocks)) as quota from c left join z on c.place = z.place group by c.place),
r as (select place, shard, j, row_number() over (partition by place order by blocks::double / (2 * j - 1) desc, shard) as rank
  from (select place, shard, blocks, unnest(range(1, 2 * blocks + 1)) as j from c)),
t as (select r.place, r.shard, count(*) as quota from r join m on r.place = m.place where r.rank <= m.quota group by r.place, r.shard),
x as (select c.*, coalesce(t.quota, 0)::hugeint as quota, cast('0x' || substr(md5('mix-1:offset:' || c.place || ':' || c.shard), 1, 8) as bigint) % greatest(c.blocks, 1) as u
  from c left join t on c.place = t.place and c.shard = t.shard),
g as (select e.*, s.place, s.size as source_size, s.target, sum(e.size) over (partition by s.place, e.shard order by e.digest, e.doc_id, e.size rows unbounded preceding) as e1
  from e join s on e.source is not distinct from s.source),
i as (select g.*, x.blocks, x.quota, x.u, b.block, unnest([e1 - g.size, e1]) as upto, unnest([-1, 1]) as sign from g join x on g.place = x.place and g.shard = x.shard, b),
k as (select *, upto // block as j from i),
n as (select *, (j + u) * quota // greatest(blocks, 1) - u * quota // greatest(blocks, 1) as before, (j + u + 1) * quota // greatest(blocks, 1) - (j + u) * quota // greatest(blocks, 1) as copies from k)
select doc_id, cast(size as bigint) as size, cast(any_value(source_size) as bigint) as source_size, any_value(target) as target, cast(sum(sign * (block * before + (upto - j * block) * copies)) as bigint) as taken
from n group by doc_id, size, place, shard, e1"""


@query("op1_quality_rules", "documents", "labels")
def op1(documents, labels):
    return quality_rules.report(documents, labels)


@query("op2_license_scan", "documents")
def op2(documents):
    return license_scan.report(documents)


@query("op3_best_fit_packing", "documents")
def op3(documents):
    return packing.pack(documents, public_tokenizers.path("byte_bpe_50k.json"))


@query("op4_pii_pseudonyms", "documents")
def op4(documents):
    return pseudonyms.report(documents)


@query("op5_ngram_jaccard_join", "documents", sql=JACCARD_SQL)
def op5(documents):
    return jaccard.join_components(documents)


@query("op6_decontamination", "documents", "benchmark", sql=CONTAMINATION_SQL)
def op6(documents, benchmark):
    return decontaminate.report(documents, benchmark)


@query("op7_line_dedup", "documents")
def op7(documents):
    return line_dedup.report(documents)


@query("op8_token_files", "documents")
def op8(documents):
    return token_files.round_trip(documents, public_tokenizers.path("word_bpe_49k.json"))


@query("op9_quality_classifier", "documents", "labels")
def op9(documents, labels):
    return weak_labels.report(documents, labels)


@query("op10_sharding", "documents")
def op10(documents):
    return sharding.shard(documents)


@query("op11_spelling_variants", "documents", sql=SPELLING_SQL)
def op11(documents):
    return spelling.report(documents)


@query("op12_prefix_trie", "conversations", sql=TRIE_SQL)
def op12(conversations):
    return prefix_trie.report(conversations)


@query("op13_source_mix", "documents", sql=MIX_SQL)
def op13(documents):
    return mixing.report(documents)


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
