"""Sources and sinks as round trips, and registered functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.functions import registry
from scorewright.operators import aggregate as A
from scorewright.operators import requests as R
from scorewright.plans.base import query, rounded, table
from scorewright.sources import io
from scorewright.sources.staging import fresh_path


@query("select doc_id, lang, source, n_chars from documents")
def src_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC2; the columns reach the scan."""
    return io.read_split(spark, f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars")


@query("select conv_id, turn, role, text from conversations")
def src_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1, SNK4: written as JSON lines and read with a schema."""
    path = fresh_path(spark, "training")
    io.write_training_set(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), path)
    return io.read_json_lines(spark, path, "conv_id bigint, turn bigint, role string, text string")


@query("select event_type as request_type, count(*) as n, count(distinct event_id) as keys from events where event_id % 2 = 0 and trim(coalesce(props, '')) <> '' and event_id % 5 > 0 group by 1")
def src_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC6, SNK6, JOIN1: every response appended to the audit log over several
    writes; the deterministic valid ones become a cache, written and read."""
    log, cache, e = fresh_path(spark, "audit"), fresh_path(spark, "cache"), F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        e.cast("string").alias("cache_key"), F.col("event_type").alias("request_type"), F.lit("t").alias("task_name"), e.alias("doc_id"), F.lit(0).alias("idx"), F.lit("{}").alias("gen_kwargs"),
        F.when(e % 5 > 0, F.col("props")).alias("response"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("created_at"), (e % 2 == 0).alias("deterministic"),
    )
    for k in range(2):
        io.append_audit(rows.where(F.col("doc_id") % 3 < 1 if k else F.col("doc_id") % 3 >= 1), log)
    audit = io.read_json_lines(spark, log, io.AUDIT_LOG).withColumn("ll", F.lit(None).cast("array<double>"))
    R.cacheable(audit, "request_type", "response").drop("ll", "deterministic").write.parquet(cache)
    return io.read_cache(spark, cache).groupBy("request_type").agg(F.count("*").alias("n"), F.countDistinct("cache_key").alias("keys"))


@query("select event_id::int as mask_idx, user_id::int as frame_idx from events where event_id % 10 > 1")
def src_frame_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7: comments and broken lines are skipped."""
    path, e = fresh_path(spark, "index"), F.col("event_id")
    line = F.when(e % 10 == 0, F.concat(F.lit("# "), e.cast("string"))).when(e % 10 == 1, F.concat(F.lit("x "), e.cast("string"))).otherwise(F.concat_ws("  ", e, "user_id"))
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    return io.read_frame_index(spark, path)


@query("""
    select o_orderpriority as task, o_orderkey as doc_id, '["' || o_orderstatus || '"]' as filtered_resps,
      case when o_orderkey % 2 = 0 then '["' || lower(o_orderstatus) || '"]' end as resps from orders""")
def snk_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1: nested lists as text, responses only where the filtered ones differ."""
    path, s = fresh_path(spark, "samples"), F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders")
    resp = F.when(F.col("o_orderkey") % 2 == 0, F.lower(s)).otherwise(s)
    io.write_samples(rows.select(F.col("o_orderpriority").alias("task"), F.col("o_orderkey").alias("doc_id"), F.array(s).alias("filtered_resps"), F.array(resp).alias("resps")), path)
    back = io.read_json_lines(spark, path, "task string, doc_id bigint, filtered_resps string, resps string")
    return back.select("task", "doc_id", "filtered_resps", "resps")


@query("select o_orderkey as id, o_orderpriority as answer, round(o_totalprice, 2) as value from orders")
def snk_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2, SNK3: a submission and a results file, read back and joined."""
    a, b = fresh_path(spark, "submission"), fresh_path(spark, "results")
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")
    io.write_submission(rows, a, "id", "o_orderpriority")
    io.write_results(rows.select("id", F.round("o_totalprice", 2).alias("value")), b)
    return io.read_json_lines(spark, a, "id bigint, answer string").join(io.read_json_lines(spark, b, "id bigint, value double"), "id")


@query("""
    with r as (select lang, (lower(lang) = case when contains(text, ' the ') then 'en' when contains(text, ' und ') then 'de' when contains(text, ' que ') then 'es' else 'fr' end)::int::double as exact_match,
      len(string_split(coalesce(text, ''), ' ')) as w from documents)
    select lang, round(avg(exact_match), 6) as exact_match, round(avg(w), 6) as n_parts, max(upper(lang)) as upper from r group by 1""")
def udf_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF1-UDF5: a registered metric with its default aggregate, a registered
    filter, and a custom function from rows to metrics in Arrow batches."""
    metric = registry.METRICS[registry.DEFAULTS["generate_until"][0]]
    custom = registry.process_results(lambda r: {"n_parts": float(len((r["text"] or "").split(" ")))}, "n_parts double")
    has = lambda word: F.col("text").contains(f" {word} ")
    guess = F.when(has("the"), "EN").when(has("und"), "DE").when(has("que"), "ES").otherwise("FR")
    rows = table(spark, sf_dir, "documents").select(
        "lang", metric.build(guess, "lang").alias(metric.name), custom(F.struct("text"))["n_parts"].alias("n_parts"), registry.FILTERS["uppercase"]("lang").alias("upper")
    )
    agg = A.AGGREGATES[metric.aggregate]
    return rounded(rows.groupBy("lang").agg(agg(F.col(metric.name), F.lit(1.0)).alias(metric.name), F.avg("n_parts").alias("n_parts"), F.max("upper").alias("upper")))
