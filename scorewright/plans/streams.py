"""Streaming operators, each run to the end over a staged copy of a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewright.operators import rollouts as RO
from scorewright.operators.ordered import placed
from scorewright.plans.base import query, rounded, shared, table
from scorewright.sources.staging import fresh_path
from scorewright.streaming import streams as ST


BATCHES = 3


def _drained(rows: DataFrame, operator: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """The operator over ``rows`` as a stream that arrives in ``BATCHES`` parts,
    by their column ``batch``; its sink is a Parquet table in the shared folder.

    After each part the stream is read to its end (availableNow) and stops, so
    the next part meets the state and the watermark of the checkpoint.  In
    update mode every batch is written whole, under its number.
    """
    spark = rows.sparkSession
    source, sink, state = (fresh_path(spark, x) for x in ("source", "sink", "state"))
    for k in range(BATCHES):
        rows.where(F.col("batch") == k).drop("batch").write.mode("append").parquet(source)
        out = operator(spark.readStream.schema(rows.drop("batch").schema).parquet(source))
        writer = out.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
        with ST.keyed_state(spark):
            if mode == "append":
                done = writer.format("parquet").option("path", sink).start()
            else:
                done = writer.foreachBatch(lambda batch, n: batch.withColumn("batch", F.lit(n).cast("long")).write.mode("append").parquet(sink)).start()
            done.awaitTermination()
    return spark.read.schema(out.schema if mode == "append" else out.schema.add("batch", T.LongType())).parquet(sink)


# ten days a batch; some rows of the first days come a batch late, behind the watermark
_BATCH = "cast(floor((day(ts) - 1) / 10) as int)"
_ARRIVAL = f"least({BATCHES - 1}, {_BATCH} + cast(event_id % 50 = 7 and (day(ts) - 1) % 10 < 5 as int))"
_ARRIVED = f"""arrived as (select *, {_ARRIVAL} as batch from events), tops as (select batch, max(ts) as top from arrived group by 1),
    seen as (select a.*, (select max(top) from tops t where t.batch < a.batch) as known from arrived a)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("batch", shared(_ARRIVAL))


@query("select user_id::varchar || event_type as cache_key, count(*) as n from (select distinct user_id, event_type from events where props is not null and trim(props) <> '') group by 1")
def str_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR1, SNK6: one response for each key (a watermark longer than the table)."""
    rows = _events(spark, sf_dir).select(F.concat(F.col("user_id").cast("string"), "event_type").alias("cache_key"), F.lit("generate_until").alias("kind"), F.col("props").alias("text"), F.array(F.lit(0.0)).alias("ll"), "ts", "batch")
    found = _drained(rows, lambda s: ST.tail_responses(s, "60 days"))
    return found.groupBy("cache_key").agg(F.count("*").alias("n"))


@query(f"""
    with {_ARRIVED}, m as (select max(ts) as top from events),
    w as (select date_trunc('day', ts) as start, event_type, value from seen where known is null or date_trunc('day', ts) + interval 1 day > known - interval 10 minute)
    select start::varchar as start, count(*) as n, round(avg((event_type = 'error')::int), 6) as failure_rate, round(avg((event_type = 'view')::int), 6) as limit_rate from w, m where start + interval 1 day <= top - interval 10 minute group by 1""")
def str_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR2: windows that the watermark has closed; rows of closed windows that come late are dropped."""
    kind = F.col("event_type")
    rows = _events(spark, sf_dir).select("ts", "batch", (kind == "error").alias("failed"), (kind == "view").alias("limited"), F.col("value").alias("latency"))
    found = _drained(rows, lambda s: ST.request_windows(s, "1 day"))
    return rounded(found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "failure_rate", "limit_rate"))


@query("select event_type, round(avg(value), 6) as mean, count(value) as n from events group by 1")
def str_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR4: the last state of each group."""
    found = _drained(_events(spark, sf_dir), lambda s: ST.running_scores(s, ["event_type"], "value"), "update")
    return rounded(found.groupBy("event_type").agg(F.max_by("mean", "batch").alias("mean"), F.max_by("n", "batch").alias("n")))


_FIGURES = f"""{_ARRIVED}, p as (select *, row_number() over (partition by event_type order by event_id) as step from seen),
    e as (select event_type as reward, step, ts, value / 100 as mean, (event_id % 37) / 500.0::double as std from p where known is null or ts > known - interval 1 day),
    f as (select reward, step, ts, mean, std, avg(mean) over w as rolling_mean, avg(std) over w as rolling_std, avg((std < 0.02 and abs(mean) < 0.05)::int) over w as saturation,
        case when count(*) over w >= 5 then regr_slope(mean, k) over w else 0 end as slope, count(*) over w as n
      from (select *, row_number() over (partition by reward order by ts, step)::double as k from e)
      window w as (partition by reward order by ts, step rows between 49 preceding and current row)),
    g as (select * from f, (select max(ts) as top from events) where ts <= top - interval 1 day)"""


def _stream_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = placed(_events(spark, sf_dir), ["event_type"], ["event_id"])
    rows = rows.select(F.col("event_type").alias("reward"), (F.col("pos") + 1).alias("step"), (F.col("value") / 100).alias("mean"), ((F.col("event_id") % 37) / 500.0).alias("std"), "ts", "batch")
    return _drained(rows, lambda s: ST.rolling_rewards(s, watermark="1 day"))


@query(f"with {_FIGURES} select reward, step, round(rolling_mean, 9) as rolling_mean, round(rolling_std, 9) as rolling_std, round(saturation, 9) as saturation, round(slope, 9) as slope, n from g")
def str_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR3: steps in the order of event time over several batches, late ones dropped."""
    return rounded(_stream_figures(spark, sf_dir).select("reward", "step", "rolling_mean", "rolling_std", "saturation", "slope", "n"), 9)


@query(f"""
    with {_FIGURES}, r as (select reward, step, case reward when 'view' then 0.1 else 0.15 end as base, case when n < 5 then 1 else greatest(0.1, least(2.0, std / case reward when 'view' then 0.1 else 0.15 end))
        * (1 - greatest(0, saturation - 0.3) / 0.7) * (1 + greatest(0, least(1, -slope / (abs(mean) + 0.05)))) end as factor from g where reward in ('view', 'click'))
    select reward, step, base::double as base_weight, round(base * factor, 9) as raw_weight, round(base * factor * sum(base) over (partition by step) / sum(base * factor) over (partition by step), 9) as weight from r""")
def str_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR3, TRJ10: adaptive weights from the figures of the stream."""
    base = {"view": 0.1, "click": 0.15}
    return rounded(RO.weights_of(_stream_figures(spark, sf_dir), base, base), 9)


@query(f"""
    with {_ARRIVED}, l as (select *, lag(ts) over (partition by user_id order by ts, event_id) as p from seen where known is null or ts + interval 6 hour > known - interval 10 minute), s as (select *, sum(coalesce((ts - p >= interval 6 hour)::int, 1)) over (partition by user_id order by ts, event_id) as k from l),
    g as (select user_id as conv_id, k, count(*) as n_turns, min(ts) as start, max(ts) as last from s group by 1, 2)
    select conv_id, strftime(start, '%Y-%m-%d %H:%M:%S') as start, n_turns from g, (select max(ts) as top from events) where last + interval 6 hour <= top - interval 10 minute""")
def str_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR5: sessions that the watermark has closed."""
    rows = _events(spark, sf_dir).select("ts", "batch", F.col("user_id").alias("conv_id"), F.col("event_type").alias("role"), F.col("props").alias("text"))
    found = _drained(rows, lambda s: ST.rollout_sessions(s, "6 hours"))
    return found.select("conv_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n_turns")
