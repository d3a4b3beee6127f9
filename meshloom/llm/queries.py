"""The registered queries of the text operators, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, decontaminate, exact, extract, langid, licenses, mix, neardup, ppm, quality, shard, topk, whiten
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return langid.identify_languages(documents, langid.train(documents))


def op2_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_text(table(spark, sf_dir, "pages"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.score_quality(documents, quality.train(documents, table(spark, sf_dir, "labels")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    spans = F.array_join(F.transform("char_spans", lambda x: F.concat_ws("-", x[0].cast("string"), x[1].cast("string"))), ",")
    return hits.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", spans.alias("hit_spans"))


#: Word windows of each length that an item asks for, looked up among the documents' runs of that many words. A word's end in the
#: original text is the length of all pieces (what is between words, and a word) up to it.
_OP7_SQL = r"""
with d as (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w, text from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where item_id is not null),
bs as (select item_id, w, least(10, len(w)) n from b where len(w) > 0),
win as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') s from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) i from bs)),
lens as (select distinct n from win),
runs as (select rid, n, i, array_to_string(w[i:i + n - 1], ' ') s from (select rid, w, n, unnest(range(1, len(w) - n + 2)) i from d cross join lens where len(w) >= n)),
hit as (select rid, item_id, r.n, i from runs r join win using (n, s)),
words as (select distinct rid, unnest(range(i, i + n)) p from hit),
pos as (select rid, count(*) n_hit from words group by rid),
run as (select rid, min(p) a, max(p) z from (select rid, p, p - row_number() over (partition by rid order by p) g from words) group by rid, g),
piece as (select rid, w, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') c from d where rid in (select rid from pos)),
span as (select rid, string_agg(length(array_to_string(c[1:a], '')) - length(w[a]) || '-' || length(array_to_string(c[1:z], '')), ',' order by a) spans from run join piece using (rid) group by rid),
its as (select rid, count(*) n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) ids from (select distinct rid, item_id from hit) group by rid)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated, coalesce(spans, '') hit_spans
from d left join pos using (rid) left join its using (rid) left join span using (rid)
"""

def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_documents(table(spark, sf_dir, "documents"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_documents(table(spark, sf_dir, "documents"))


_OP8_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size,
    -ln((('0x' || substr(md5('mix-1-' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0)
    / greatest(0.05, 1.0::double - 4.0::double * (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#$%&*+<=>@[]^_{|}~!', ''))) / greatest(length(coalesce(text, '')), 1)) k
  from documents),
s as (select source, sum(size)::bigint source_size, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] w from d group by source),
r as (select *, source_size * 2 cap, source_size * 2 / w ratio, sum(source_size) over ()::double * 1.5::double total from s),
l as (select *, (total - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0)::double) / sum(w) over (order by ratio, source nulls last rows between current row and unbounded following)::double lev, row_number() over (order by ratio, source nulls last) nth from r),
t as (select source, source_size, coalesce(least(cap::double, (select arg_min(lev, nth) from l where lev <= ratio) * w), 0.0)::double target from l),
o as (select d.doc_id, d.size, d.source, sum(d.size) over (partition by d.source order by k, doc_id, size rows unbounded preceding) upto from d),
e as (select o.*, source_size, target, case when source_size > 0 then floor(target / source_size)::bigint else 0 end epochs from o join t on o.source is not distinct from t.source)
select doc_id, size, source_size, target, (size * (epochs + case when upto - size / 2 <= target - epochs * source_size then 1 else 0 end))::bigint taken from e
"""

def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("matches").alias("n_licenses"),
        F.array_join(F.col("matches.license"), ",").alias("licenses"),
        F.coalesce(F.array_max("matches.containment"), F.lit(0.0)).alias("containment"),
    )


_OP9_TEMPLATES = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in licenses.TEMPLATES.items())
#: Every run of every text against every template's runs, without sketches or anchors.
_OP9_SQL = rf"""
with t as (select name, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from (values {_OP9_TEMPLATES}) v(name, text)),
tr as (select distinct name, n, array_to_string(w[i:i + n - 1], ' ') s from (select name, w, least(5, len(w)) n, unnest(range(1, len(w) - least(5, len(w)) + 2)) i from t)),
tn as (select name, count(*) c from tr group by name),
d as (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
dr as (select distinct rid, n, array_to_string(w[i:i + n - 1], ' ') s from (select rid, w, n, unnest(range(1, len(w) - n + 2)) i from d cross join (select distinct n from tr) where len(w) >= n)),
m as (select rid, name, count(*) / any_value(c)::double share from dr join tr using (n, s) join tn using (name) group by rid, name having count(*) / any_value(c)::double >= 0.8 - 1e-9)
select doc_id, count(name)::int n_licenses, coalesce(string_agg(name, ',' order by name), '') licenses, coalesce(max(share), 0.0)::double containment from d left join m using (rid) group by rid, doc_id
"""


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


_OP10_SQL = """
with e as (select vec_id, embedding from embeddings where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c as (select vec_id, unnest(range(len(embedding))) i, unnest(list_transform(embedding, lambda x: floor(256 * x::double)::bigint)) v from e),
p as (select q.vec_id query_id, c.vec_id, sum(q.v * c.v)::bigint score from c q join c on q.i = c.i and q.vec_id <> c.vec_id where q.vec_id % 50 = 0 group by all),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from p)
select query_id, rank, vec_id, score from r where rank <= 5
"""



def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Each order is played step by step over the counts of documents that fail the same filters, and Shapley sums add up what came of it.
_OP11_SQL = r"""
with d as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t, min(doc_id) over (partition by coalesce(text, '')) least from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w from d),
m as (select doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] f from w),
l as (select doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic from labels group by doc_id),
c as (select part, f, count(*) n, count(*) filter (good) good, count(*) filter (toxic) toxic from m left join l using (doc_id) group by part, f),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) i),
o as (select a.i || b.i || c.i || d.i || e.i filter_order from x a, x b, x c, x d, x e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s as (select part, filter_order, step::int step, f[strpos('ABCDE', filter_order[step])] fails, len(list_filter(range(1, step), lambda k: f[strpos('ABCDE', filter_order[k])])) > 0 gone, len(list_filter(f, lambda y: y)) = 1 one, n, good, toxic from c, o, range(1, 6) r(step)),
r as (select part, filter_order, step, filter_order[step] i, sum(case when not gone and not fails then n else 0 end)::bigint kept, sum(case when fails and not gone then n else 0 end)::bigint removed, sum(case when fails and gone then n else 0 end)::bigint redundant,
  sum(case when fails and one then n else 0 end)::bigint unique_fails, sum(case when fails and not gone then good else 0 end)::bigint good_lost, sum(case when fails and not gone then toxic else 0 end)::bigint toxic_lost from s group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, i))::bigint shapley from r
"""


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


_OP12_SQL = """
with d as (select doc_id, coalesce(text, '') t from documents)
select doc_id, first_value(doc_id) over g keep_id, count(*) over (partition by t) group_size, row_number() over g = 1 kept, sha256(t) text_sha256
from d window g as (partition by t order by doc_id desc nulls last)
"""


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_extract": op2_extract,
    "op3_lm_score": op3_lm_score,
    "op4_near_dedup": op4_near_dedup,
    "op5_quality": op5_quality,
    "op6_shard": op6_shard,
    "op7_decontaminate": op7_decontaminate,
    "op8_mix": op8_mix,
    "op9_licenses": op9_licenses,
    "op10_topk": op10_topk,
    "op11_filter_audit": op11_filter_audit,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_whiten": op13_whiten,
}

ORACLES: dict[str, str] = {
    "op7_decontaminate": _OP7_SQL,
    "op8_mix": _OP8_SQL,
    "op9_licenses": _OP9_SQL,
    "op10_topk": _OP10_SQL,
    "op11_filter_audit": _OP11_SQL,
    "op12_exact_dedup": _OP12_SQL,
}
