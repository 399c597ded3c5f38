"""The operators over the tables of a folder, as the driver's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary, decontam, linededup, lm, neardup, packing, pii, quality, sharding, suffix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("n_removed").alias("n_removed_lines"), F.length("text").cast("long").alias("n_kept_chars"), F.crc32(F.coalesce("text", F.lit(""))).alias("kept_crc32"))


def op3_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_recurrent_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


def op5_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op6_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.read_files(spark, binary.write_files(table(spark, sf_dir, "documents")), with_ids=False)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(table(spark, sf_dir, "documents"))


def op8_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    counts = [F.coalesce(F.size(F.expr(f"filter(base, s -> s.kind = {k})")), F.lit(0)).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS, 1)]
    return found.select("doc_id", *counts, F.sha2(pii.text_of("base"), 256).alias("base_sha256"), pii.text_of("spans").alias("spans"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= decontam.MIN_ITEMS).alias("contaminated"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_features(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_fuzzy_line_dedup, op3_minimax_sharding, op4_recurrent_lm_scoring, op5_minmax_near_dedup, op6_token_id_files, op7_suffix_dedup, op8_weak_supervision_pii, op9_benchmark_decontamination, op10_quality_rules)}

ORACLES: dict[str, str] = {}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op5_minmax_near_dedup"] = f"""with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as w from documents),
 s as (select distinct doc_id, k from (select doc_id, array_to_string(w[i:i + 2], ' ') as k from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from d where len(w) > 0))),
 n as (select doc_id, count(*) as n from s group by doc_id),
 p as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.k = y.k and x.doc_id <> y.doc_id group by 1, 2),
 e as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * p.c >= 85 * (x.n + y.n - p.c)),
 r as (select doc_id as id, doc_id as c from documents union select e.b, r.c from r join e on e.a = r.id where r.c < e.b),
 g as (select id, min(c) as c from r group by id)
 select d.doc_id, coalesce(n.n, 0) as n_shingles, g.c as component_id, d.doc_id = g.c as kept from d left join n using (doc_id) join g on g.id = d.doc_id"""

ORACLES["op7_suffix_dedup"] = """with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
 p as (select doc_id, i, substr(h, 2 * i + 1, 100) as k from (select doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) as i from d)),
 f as (select k, min(doc_id) as first from p group by k having count(distinct doc_id) > 1),
 g as (select p.doc_id, p.i from p join f on f.k = p.k where f.first < p.doc_id),
 m as (select doc_id, i, i > coalesce(lag(i) over (partition by doc_id order by i) + 50, -1) as new from g),
 s as (select doc_id, min(i) as a, max(i) + 50 as b from (select *, sum(new::int) over (partition by doc_id order by i) as k from m) group by doc_id, k),
 q as (select doc_id, list(a order by a) as a, list(b order by b) as b from s group by doc_id)
 select d.doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(list_sum(b) - list_sum(a), 0) as bigint) as n_removed, coalesce(len(a), 0)::bigint as n_spans,
  sha256(unhex(coalesce(array_to_string(list_transform(range(1, len(a) + 2), lambda j: substr(h, 2 * coalesce(case when j > 1 then b[j - 1] end, 0) + 1, 2 * (coalesce(a[j], len(h) // 2) - coalesce(case when j > 1 then b[j - 1] end, 0)))), ''), h))) as kept_sha256
 from d left join q using (doc_id)"""

ORACLES["op9_benchmark_decontamination"] = f"""with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
 b as (select item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark where item_id is not null),
 s as (select item_id, least(8, len(w)) as n, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) as i from b where len(w) > 0),
 win as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as k from s),
 sizes as (select distinct n from win),
 p as (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n),
 h as (select p.doc_id, p.i, p.n, win.item_id from (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as k from p) p join win on win.n = p.n and win.k = p.k),
 c as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from (select distinct doc_id, i, n from h)) group by doc_id),
 f as (select doc_id, count(distinct item_id) as n_items, array_to_string(list_sort(list_distinct(list(cast(item_id as varchar)))), ',') as ids from h group by doc_id)
 select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(c.n_hit, 0) as n_hit, coalesce(f.n_items, 0) as n_items, sha256(coalesce(f.ids, '')) as items_sha256, coalesce(f.n_items, 0) >= 2 as contaminated
 from d left join c using (doc_id) left join f using (doc_id)"""
