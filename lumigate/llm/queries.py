"""The registered queries opN_<name>: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, byte_bpe, conversations, html_extract, line_dedup, lm_scoring, media, mixing, ngram_join, pii, quality, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines_removed", F.length("text").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source at least once and at most four times, as near to alike as that allows."""
    found = mixing.mix(_table(spark, sf_dir, "documents"), max_repetition=4.0)
    return found.select("doc_id", "source", "mix_epoch", "mix_block", "mix_place")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.cross_entropy_difference(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_digests(_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "lang", "perplexity", "threshold", "keep")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_digests(_table(spark, sf_dir, "documents"))


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired_digests(conversations.damaged(_table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_toxicity": op2_toxicity,
    "op3_line_dedup": op3_line_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_mixing": op5_mixing,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_pii": op7_pii,
    "op8_media": op8_media,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_ann": op10_ann,
    "op11_alignment": op11_alignment,
    "op12_html": op12_html,
    "op13_conversations": op13_conversations,
}
#: The whole join in SQL: every pair that shares a shingle, then closure over the links.
NGRAM_JOIN_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
l as (select doc_id, list_sort(list_distinct(case when w is null or len(w) = 0 then cast([] as varchar[]) when len(w) < 5 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end)) as g from w),
s as (select doc_id, unnest(g) as g from l),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join l x on x.doc_id = a join l y on y.doc_id = b where 100 * c >= 80 * (len(x.g) + len(y.g) - c)),
u as (select a, b from e union all select b, a from e),
r as (select doc_id as id, doc_id as root from documents union select u.b, r.root from r join u on u.a = r.id),
m as (select md5(array_to_string(g, '|')) as k, min(doc_id) as class_id from l where len(g) > 0 group by 1)
select l.doc_id, cast(len(g) as bigint) as n_shingles, component_id, coalesce(class_id, l.doc_id) as class_id
from l join (select id, min(root) as component_id from r group by id) on id = l.doc_id left join m on len(g) > 0 and k = md5(array_to_string(g, '|'))
"""
#: The mixing in SQL: the bisection as a recursion of halvings, then each source's cut by running sums.
MIXING_SQL = r"""
with recursive small as (select doc_id, source as s, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as t,
    cast('0x' || substr(md5('0:' || coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')), 1, 15) as bigint) as k from documents),
sources as (select s, sum(t) as tokens from small group by s),
shares as (select sum(tokens) as total, cast(min(tokens) as double) / sum(tokens) as p_least, cast(max(tokens) as double) / sum(tokens) as p_most from sources where tokens > 0),
halved as (select 0 as i, 0e0 as lo, 1e0 as hi union all
  select i + 1, case when good then lo else mid end, case when good then mid else hi end from (
    select i, lo, hi, (lo + hi) / 2 as mid, pow(p_most, 1 - (lo + hi) / 2) * pow(p_least, (lo + hi) / 2 - 1) <= 4 * (1 + 1e-12) as good from halved, shares) where i < 40),
chosen as (select case when p_most / p_least <= 4 * (1 + 1e-12) then 0e0 else hi end as e from halved, shares where i = 40),
timed as (select s, tokens, case when tokens > 0 then pow(p_most, 1 - e) * pow(cast(tokens as double) / total, e - 1) else 1e0 end as times from sources, shares, chosen),
budgets as (select s, cast(floor(times + 1e-9) as bigint) as whole, (times - floor(times + 1e-9)) * tokens as rest, greatest(1, cast(floor(cast(tokens as double) / 65536) as bigint)) as blocks from timed),
placed as (select doc_id, small.s, t, k, whole, rest, blocks, cast('0x' || substr(md5('0:' || whole || ':' || k % blocks), 1, 15) as bigint) as o,
  cast('0x' || substr(md5('0:' || whole || ':' || k), 1, 15) as bigint) as p from small join budgets on small.s is not distinct from budgets.s),
blocked as (select s, o, any_value(rest) as rest, sum(t) as t, sum(sum(t)) over (partition by s order by o) - sum(t) as before from placed where t > 0 and rest > 0 group by s, o),
last as (select * from blocked where before < rest and before + t >= rest),
ends as (select s, o as lo, coalesce(max(p) filter (before + run <= rest), -1) as lp from (
  select p.s, p.o, p.p, l.before, l.rest, sum(p.t) over (partition by p.s order by p.p) as run from placed p join last l on p.s is not distinct from l.s and p.o = l.o where p.t > 0) group by s, o),
taken as (select doc_id, placed.s, k, blocks, whole + cast(coalesce(o < lo or (o = lo and p <= lp), false) as bigint) as copies from placed left join ends on placed.s is not distinct from ends.s)
select doc_id, s as source, cast(epoch as int) as mix_epoch, cast('0x' || substr(md5('0:' || epoch || ':' || k % blocks), 1, 15) as bigint) as mix_block,
  cast('0x' || substr(md5('0:' || epoch || ':' || k), 1, 15) as bigint) as mix_place from (select *, unnest(generate_series(0, copies - 1)) as epoch from taken where copies > 0)
"""
#: The main text of the given pages in SQL: they mark it as an article of p and h1, with few character references.
HTML_SQL = r"""
with a as (select page_id, url, regexp_replace(regexp_replace(coalesce(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), ''), '</?b>', '', 'g'), '<br>', ' ', 'g') as a from pages),
b as (select page_id, url, list_transform(regexp_split_to_array(a, '</?(?:p|h1)>'), lambda x: trim(regexp_replace(
  replace(replace(replace(replace(replace(replace(replace(x, '&quot;', '"'), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g'))) as b from a)
select page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10)) as text, cast(length(array_to_string(list_filter(b, lambda x: x <> ''), chr(10))) as bigint) as n_chars from b
"""
#: The repair in SQL: crc32 by its table, then the cheapest (cost, audit) of each state, from the last row back.
CONVERSATIONS_SQL = r"""
with recursive t as (select list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, cast(x as bigint))) as t),
c as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as name from conversations),
k as (select c.*, xor(4294967295, list_reduce(list_transform(range(1, length(name) + 1), lambda i: cast(unicode(name[i]) as bigint)), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1]), 4294967295)) % 20 as k from c, t),
d as (select conv_id, turn, case when k = 4 then 'user' else role end as role, case k when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(range(case k when 0 then 0 when 3 then 2 else 1 end)) as copy from k),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, md5(length(role) || ':' || role || ':' || text), copy) - 1 as i, left(role, 1) as r from d),
f as (select *, case when rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' then 1 when row_number() over (partition by conv_id, role, text order by i) > 1 then 2
  when right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) not in ('.', '!', '?') then 3 else 0 end as f, lag(r) over (partition by conv_id order by i) as before from o),
n as (select conv_id, count(f.i) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(f = 1) as blank, count_if(f = 2) as duplicate, count_if(f = 3) as truncated,
  count_if(before is not null and before || r not in ('su', 'ua', 'au')) as illegal from (select distinct conv_id from conversations) x left join f using (conv_id) group by conv_id),
w as (select conv_id, n as i, {'c': 0, 'a': '', 'r': cast([] as varchar[])} as w0, {'c': 4, 'a': 'II', 'r': ['user:', 'assistant:']} as w1, {'c': 2, 'a': 'I', 'r': ['assistant:']} as w2, {'c': 0, 'a': '', 'r': cast([] as varchar[])} as w3 from n
 union all
 select conv_id, i, case when u0 < {'c': v2.c + 2, 'a': 'I' || v2.a, 'r': list_prepend('user:', v2.r)} then u0 else {'c': v2.c + 2, 'a': 'I' || v2.a, 'r': list_prepend('user:', v2.r)} end,
   case when u1 < {'c': v2.c + 2, 'a': 'I' || v2.a, 'r': list_prepend('user:', v2.r)} then u1 else {'c': v2.c + 2, 'a': 'I' || v2.a, 'r': list_prepend('user:', v2.r)} end, v2,
   case when u3 < {'c': v2.c + 2, 'a': 'I' || v2.a, 'r': list_prepend('user:', v2.r)} then u3 else {'c': v2.c + 2, 'a': 'I' || v2.a, 'r': list_prepend('user:', v2.r)} end
 from (select *, case when u2 < {'c': u3.c + 2, 'a': 'I' || u3.a, 'r': list_prepend('assistant:', u3.r)} then u2 else {'c': u3.c + 2, 'a': 'I' || u3.a, 'r': list_prepend('assistant:', u3.r)} end as v2
 from (select w.conv_id, w.i - 1 as i,
   list_min([{'c': w0.c + 3, 'a': 'D' || w0.a, 'r': w0.r}, case when ok and r = 's' then {'c': w1.c + t, 'a': 'K' || w1.a, 'r': list_prepend(line, w1.r)} end, case when ok and r = 'u' then {'c': w2.c + t, 'a': 'K' || w2.a, 'r': list_prepend(line, w2.r)} end, case when ok then {'c': w2.c + 2 + t, 'a': 'R' || w2.a, 'r': list_prepend('user:' || text, w2.r)} end]) as u0,
   list_min([{'c': w1.c + 3, 'a': 'D' || w1.a, 'r': w1.r}, case when ok and r = 'u' then {'c': w2.c + t, 'a': 'K' || w2.a, 'r': list_prepend(line, w2.r)} end, case when ok then {'c': w2.c + 2 + t, 'a': 'R' || w2.a, 'r': list_prepend('user:' || text, w2.r)} end]) as u1,
   list_min([{'c': w2.c + 3, 'a': 'D' || w2.a, 'r': w2.r}, case when ok and r = 'a' then {'c': w3.c + t, 'a': 'K' || w3.a, 'r': list_prepend(line, w3.r)} end, case when ok then {'c': w3.c + 2 + t, 'a': 'R' || w3.a, 'r': list_prepend('assistant:' || text, w3.r)} end]) as u2,
   list_min([{'c': w3.c + 3, 'a': 'D' || w3.a, 'r': w3.r}, case when ok and r = 'u' then {'c': w2.c + t, 'a': 'K' || w2.a, 'r': list_prepend(line, w2.r)} end, case when ok then {'c': w2.c + 2 + t, 'a': 'R' || w2.a, 'r': list_prepend('user:' || text, w2.r)} end]) as u3
 from w join (select *, role || ':' || text as line, cast(f = 3 as integer) as t, f not in (1, 2) as ok from f) f on w.conv_id is not distinct from f.conv_id and f.i = w.i - 1)))
select w.conv_id, gaps, blank, duplicate, truncated, illegal, cast(w0.c as bigint) as cost, w0.a as audit, sha256(array_to_string(w0.r, chr(10))) as repaired_sha256 from w join n on w.conv_id is not distinct from n.conv_id where w.i = 0
"""
ORACLES: dict[str, str] = {"op12_html": HTML_SQL, "op13_conversations": CONVERSATIONS_SQL, "op1_ngram_jaccard_join": NGRAM_JOIN_SQL, "op5_mixing": MIXING_SQL}
