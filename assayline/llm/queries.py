"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm import (
    centroid_clustering,
    conversation_repair,
    decontamination,
    fingerprints,
    html_extract,
    line_dedup,
    minhash_dedup,
    mixing,
    quality_classifier,
    suffix_dedup,
    token_counts,
    topk_search,
    warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), with_bytes=False).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints_of_edits(_table(spark, sf_dir, "documents"))


def op5_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(spark, _table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    ).select("doc_id", "text_score", "meta_score", "score", "rejected", (~F.col("rejected")).alias("kept"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), size=2)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines_removed", F.length("text").cast("long").alias("n_chars_kept"),
        F.sha2("text", 256).alias("kept_sha256"), "text",
    )


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.clustered(_table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damaged(_table(spark, sf_dir, "conversations"))
    return conversation_repair.reports(damaged, dropped="dropped")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_html_extraction": op3_html_extraction,
    "op4_document_fingerprints": op4_document_fingerprints,
    "op5_warc_packages": op5_warc_packages,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_source_mixing": op10_source_mixing,
    "op11_exact_topk": op11_exact_topk,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_conversation_repair": op13_conversation_repair,
}

_WHOLE = """whole as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0
)"""


def _clustering_sql(rounds: int = 5, centroids: int = 40, size: int = 64) -> str:
    """k-means in SQL: a pair of common table expressions for each round."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""near{i} as materialized (
  select vec_id, v, min(struct_pack(
           d := list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint,
           k := cluster)) as best
  from kept, c{i} group by vec_id, v
)""")
        if i < rounds:
            steps.append(f"""c{i + 1} as materialized (
  select cluster, coalesce(m.c, c{i}.c) as c
  from c{i} left join (
    select cluster, list(mean order by i) as c
    from (select best.k as cluster, i, floor(sum(v[i])::double / count(*))::bigint as mean
          from near{i}, generate_series(1, {size}) as g(i) group by all)
    group by cluster
  ) m using (cluster)
)""")
    return f"""with {_WHOLE}, kept as materialized (
  select * from whole where len(v) = {size}
), c0 as materialized (
  select (row_number() over (order by sha256('2:' || vec_id), v) - 1)::int as cluster, v as c
  from kept order by cluster limit {centroids}
), {", ".join(steps)}
select vec_id, best.k as cluster, best.d as distance,
       (sum(best.d) over (partition by best.k))::bigint as cluster_inertia,
       (sum(best.d) over ())::bigint as inertia,
       sha256(array_to_string(c, ',')) as centroid_sha256
from near{rounds} join c{rounds} on cluster = best.k"""


ORACLE = {
    "op11_exact_topk": f"""with {_WHOLE}, scored as (
  select q.vec_id as query_id, c.vec_id,
         list_dot_product(q.v::double[], c.v::double[])::bigint as score
  from whole q join whole c on len(q.v) = len(c.v) and q.vec_id <> c.vec_id
  where q.vec_id % 50 = 0
), ranked as (
  select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank
  from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5""",
    "op12_centroid_clustering": _clustering_sql(),
    "op10_source_mixing": r"""
with sized as (
  select doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as name
  from documents
), sizes as (
  select source, sum(size)::bigint as source_size from sized group by source
), ranked as (
  select source, source_size, source_size * 3 as cap,
         case (row_number() over (order by source nulls last) - 1) % 3
           when 0 then 5 when 1 then 2 else 1 end::bigint as weight
  from sizes
), levels as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over fill, 0))::double
            / (sum(weight) over () - coalesce(sum(weight) over fill, 0))::double as level
  from ranked
  window fill as (order by cap::double / weight, source nulls last
                  rows between unbounded preceding and 1 preceding)
), rested as (
  select *, max(level) over () as rest
  from levels
), plan as (
  select source, source_size,
         case when cap::double / weight < level then cap::double
              else least(cap::double, weight * rest) end as target
  from rested
), rated as (
  select d.*, p.source_size, p.target,
         case when p.source_size > 0 then p.target / p.source_size else 0 end as rate
  from sized d join plan p on d.source is not distinct from p.source
), drawn as (
  select r.*, seed,
         ('0x' || substr(md5('mix:' || (seed // 4) || ':' || name), (8 * (seed % 4) + 1)::int, 8))::bigint
           / 4294967296.0::double < rate - floor(rate) as more
  from rated r, generate_series(0, 31) as g(seed)
), sums as (
  select source, seed, abs(any_value(floor(rate) * source_size - target) + sum(case when more then size else 0 end)) as miss
  from drawn group by source, seed
), used as (
  select source, arg_min(seed, struct_pack(m := miss, s := seed)) as seed from sums group by source
)
select d.doc_id, d.size, d.source_size, d.target,
       d.size * (floor(d.rate) + d.more::int)::bigint as taken
from drawn d join used u on d.source is not distinct from u.source and d.seed = u.seed
""",
}
