"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, embeddings, langid, licenses, minhash, mixing, pii, quality, sharding, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.linked(table(spark, sf_dir, "embeddings"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.train())


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.document_components(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts n_ are of base spans, as the contract fixes them; spans holds all, n_added counts the others."""
    found = pii.find_personal_data(table(spark, sf_dir, "documents"), pii.train())
    return found.select("doc_id", *[F.col(f"base_{k}").alias(f"n_{k}") for k in pii.KINDS], "base_sha256", "spans", "n_spans", "n_added")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_texts(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_sharding, op2_license_scan, op3_embedding_near_dedup, op4_mixing, op5_url_filter, op6_language_id, op7_minhash_near_dedup, op8_pii, op9_quality_classifier, op10_decontamination)
    }


def _sharding_sql() -> str:
    """The permutation once more, step by step in a recursive query; crc32 bit by bit."""
    bits = [1 << i for i in range(8)]
    for _ in range(8):
        bits = [(x >> 1) ^ (0xEDB88320 if x & 1 else 0) for x in bits]
    crc = "s >> 8"
    for i, x in enumerate(bits):
        crc = f"xor({crc}, (xor(s, x) >> {i} & 1) * {x})"
    keys = sharding._round_keys(sharding.SEED)
    key = lambda j: f"([{', '.join(str(k[j]) for k in keys)}]::bigint[])[i + 1]"
    once = lambda x: f"(({x} % {sharding.PRIME}) * {key(0)} + {key(1)}) % {sharding.PRIME}"
    hashed = lambda x: f"((({once(x)}) * ({once(x)}) + {key(2)}) % {sharding.PRIME})"
    done = f"i = {sharding.ROUNDS}"
    return f"""
with recursive h as (select doc_id, text, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::bigint) as b from documents),
d as (select doc_id, coalesce(len(b), 0)::bigint + 1 as size, case when text is null then null else xor(list_reduce(b, lambda s, x: {crc}, 4294967295::bigint), 4294967295::bigint) end as text_crc32 from h),
c as (select *, {sharding.cell_expr("doc_id", "size")} as cell from d),
n as (select *, row_number() over (order by cell, doc_id nulls first, size, text_crc32 nulls first) - 1 as r, count(*) over () as n, ceil(sqrt(count(*) over ()))::bigint as a from c),
s as (select *, (n + a - 1) // a as b from n),
w as (select r, n, a, b, r // b as l, r % b as m, 0 as i from s
  union all select r, n, a, b, case when {done} then (l * b + m) // b when i % 2 = 0 then (l + {hashed("m")}) % a else l end, case when {done} then (l * b + m) % b when i % 2 = 1 then (m + {hashed("l")}) % b else m end, case when {done} then 0 else i + 1 end
  from w where i < {sharding.ROUNDS} or l * b + m >= n),
p as (select r, l * b + m as p from w where {done} and l * b + m < n)
select doc_id, size, text_crc32, 'rows' as law, (p % 16)::int as shard, p // 16 as slot, null::int as grown_shard from s join p using (r)
"""


SHARDING_SQL = _sharding_sql()

EMBEDDINGS_SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as e, row_number() over () as r,
    coalesce(label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0, false) as usable
  from embeddings),
u as (select * from v where usable),
l as (select a.r as a, b.r as b from u a join u b on a.label = b.label and a.r <> b.r and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.98),
reach as (select r, r as other from v union select reach.r, l.b from reach join l on l.a = reach.other),
c as (select reach.r, min(v.vec_id) as component_id from reach join v on v.r = reach.other group by reach.r),
n as (select a, count(*) as n from l group by a)
select v.vec_id, coalesce(n.n, 0) as n_links, c.component_id, v.vec_id is not distinct from c.component_id as kept
from v join c on c.r = v.r left join n on n.a = v.r
"""

MIXING_SQL = """
with d as (select doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size, case when source is null then 'n' else '=' || source end as k from documents),
s as (select k, sum(size)::bigint as source_size from d group by k),
r as (select *, ([3, 1, 2][((row_number() over (order by k) - 1) % 3 + 1)])::double as w, 2 * source_size::double as cap from s),
l as (select *, (1.5::double * (sum(source_size) over ())::double - coalesce(sum(cap) over ahead, 0)) / (sum(w) over () - coalesce(sum(w) over ahead, 0)) as level
  from r window ahead as (order by cap / w, k rows between unbounded preceding and 1 preceding)),
t as (select k, source_size, least(cap, max(level) over () * w) as target from l),
o as (select d.*, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0 end as rate, ('0x' || substr(md5(d.k), 1, 8))::bigint / 4294967296::double as u,
  case when size = 0 then 0 else length(bin(size)) * 32 + (size * 32) // (1::bigint << length(bin(size))) end as class,
  ((coalesce(doc_id, 0) % 1000003 + 1000003) % 1000003) * 2654435761 % 2147483647 % 1024 as cell from d join t using (k)),
b as (select *, row_number() over (partition by k order by class, cell, doc_id nulls first, size) - 1 as b from o)
select doc_id, size, source_size, target, (size * (floor((b + 1) * rate + u) - floor(b * rate + u)))::bigint as taken from b
"""

NEAR_DUPLICATES_SQL = """
with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select r, doc_id, case when len(w) >= 3 then list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as sh from d),
e as (select r, len(sh) as n, unnest(sh) as x from s),
p as (select a.r as a, b.r as b, count(*) as i, any_value(a.n) as na, any_value(b.n) as nb from e a join e b on a.x = b.x and a.r <> b.r and least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85 group by a.r, b.r),
l as (select a, b from p where 100 * i >= 85 * (na + nb - i)),
reach as (select r, r as other from s union select reach.r, l.b from reach join l on l.a = reach.other),
c as (select reach.r, min(s.doc_id) as component_id from reach join s on s.r = reach.other group by reach.r)
select s.doc_id, len(s.sh)::bigint as n_shingles, c.component_id, s.doc_id is not distinct from c.component_id as kept from s join c on c.r = s.r
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": SHARDING_SQL, "op3_embedding_near_dedup": EMBEDDINGS_SQL, "op4_mixing": MIXING_SQL, "op7_minhash_near_dedup": NEAR_DUPLICATES_SQL}
