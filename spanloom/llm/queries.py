"""The corpus operators as queries over whole tables, and their oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import codes, exact, grouping, langid, mixing, negatives, packing, pivots, sharding, simhash, substring, toxicity, urls
from spanloom.shared import spread


#: Bytes of a shard in the query: so few that the smallest tables are split too. The operator's own default is larger.
SHARD = 256 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact.exact_groups(table(spark, sf_dir, "documents"), digests=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), SHARD)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def op12_grouped_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.pack_grouped(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = codes.compress(table(spark, sf_dir, "embeddings"))
    out = codes.with_label_errors(found)
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.named(books)).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_substring": op2_substring,
        "op3_mixing": op3_mixing,
        "op4_toxicity": op4_toxicity,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_packing": op6_packing,
        "op7_url_filter": op7_url_filter,
        "op8_language_id": op8_language_id,
        "op9_sharding": op9_sharding,
        "op10_embedding_dedup": op10_embedding_dedup,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_grouped_packing": op12_grouped_packing,
        "op13_vector_codes": op13_vector_codes,
    }


OP5 = r"""
with n as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as c from documents),
g as (select c, count(*) as group_size, first(doc_id order by length(t) desc, doc_id) as keep_id from n group by c)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(c) as text_sha256 from n join g using (c)
"""


#: Windows are compared by a hash of their words; a word goes when the last repeated window before it is no more than 49 words back.
OP2 = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as k from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d)),
seen as (select k, min(doc_id) as first_id from win group by k),
again as (select doc_id, i from win join seen using (k) where first_id < doc_id),
word as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as t from d),
cut as (select doc_id, i, t, coalesce(max(again.i) over (partition by word.doc_id order by word.i rows unbounded preceding) >= word.i - 49, false) as gone from word left join again using (doc_id, i)),
per as (select doc_id, count_if(gone) as n_removed, coalesce(string_agg(t, ' ' order by i) filter (not gone), '') as kept from cut group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join per using (doc_id)
"""

#: All pairs of a label; the index finds them all where its recall is 1, as on the tables that this runs over.
OP10 = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
link as (select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.98),
reach as (select vec_id as x, vec_id as y from v union select reach.x, link.y from reach join link on reach.y = link.x),
c as (select x as vec_id, min(y) as component_id from reach group by x),
n as (select x as vec_id, count(*) as n from link group by x)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept from v join c using (vec_id) left join n using (vec_id)
"""

#: Depth by depth, a bucket is a leaf when it fits the limit or holds one document.
OP9 = f"""
with d as (select doc_id, coalesce(strlen(text), 0) as n_bytes, ('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint as h from documents),
l as (select d.*, depth, h >> (60 - depth) as bucket from d, (select unnest(range(0, 61)) as depth)),
s as (select depth, bucket, sum(n_bytes) as b, count(*) as n from l group by all),
f as (select doc_id, min(depth) as depth from l join s using (depth, bucket) where b <= {SHARD} or n = 1 group by doc_id)
select doc_id, n_bytes, depth::int as depth, bucket, 0::bigint as chain from l join f using (doc_id, depth)
"""


#: Every anchor against every row.
OP11 = """
with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, embedding as e from embeddings),
v as (
  select vec_id, label, list_transform(e, lambda x: floor(256 * x::double)::bigint) as q from r
  where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
),
s as (
  select a.vec_id as a, c.vec_id as c, a.label = c.label as same, list_sum(list_transform(list_zip(a.q, c.q), lambda z: z[1] * z[2]))::bigint as score
  from v a join v c on a.vec_id % 50 = 0 and a.vec_id <> c.vec_id
),
p as (select a, c, score from s where same qualify row_number() over (partition by a order by score desc, c) <= 5)
select p.a as anchor_id, p.c as positive_id, row_number() over (partition by p.a, p.c order by s.score desc, s.c)::int as rank,
  s.c as negative_id, p.score as positive_score, s.score as negative_score
from p join s on s.a = p.a and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score
qualify rank <= 3
"""


#: Every part against every entry, round by round; entries that no part is nearest to stay.
def _op13() -> str:
    nearest = """
{n}d as (select v.vec_id, v.part, b.entry, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from parts v join {b} b using (part)),
{n}a as (select vec_id, part, min(d) as d, arg_min(entry, d * 1000 + entry) as entry from {n}d group by all)"""
    refine = """
{n} as (
  select b.part, b.entry, coalesce(m.x, b.x) as x from {b} b left join (
    select part, entry, list((t - ((t % n) + n) % n) // n order by place) as x
    from (select part, entry, place, sum(y)::bigint as t, count(*) as n from (select a.part, a.entry, unnest(p.x) as y, unnest(range(1, len(p.x) + 1)) as place from {b}a a join parts p using (vec_id, part)) group by all)
    group by all
  ) m using (part, entry)
)"""
    steps = []
    for k in range(3):
        steps.append(nearest.format(n=f"b{k}", b=f"b{k}"))
        if k < 2:
            steps.append(refine.format(n=f"b{k + 1}", b=f"b{k}"))
    return f"""
with v as (
  select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
parts as (select vec_id, part, q[part * (len(q) // 16) + 1:(part + 1) * (len(q) // 16)] as x from v, (select unnest(range(0, 16)) as part)),
first64 as (select vec_id, row_number() over (order by vec_id) - 1 as entry from v qualify entry < 64),
b0 as (select part, entry, x from parts join first64 using (vec_id)),
{",".join(steps)},
e as (select vec_id, string_agg(printf('%02x', entry::int), '' order by part) as code, sum(d)::bigint as error from b2a group by vec_id),
l as (select vec_id, (sum(error) over (partition by label))::bigint as label_error from e join v using (vec_id)),
h as (select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) as codebooks_sha256 from b2)
select vec_id, code, error, label_error, codebooks_sha256 from e join l using (vec_id), h
"""


OP13 = _op13()


def oracle_sql() -> dict[str, str]:
    return {"op2_substring": OP2, "op5_exact_dedup": OP5, "op9_sharding": OP9, "op10_embedding_dedup": OP10, "op11_hard_negatives": OP11, "op13_vector_codes": OP13}
