"""Requests, runs, samples, windows, keys, rollouts: table-level queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.functions import keys as K
from scorewright.functions import trajectory as T
from scorewright.operators import requests as R
from scorewright.operators import rollouts as RO
from scorewright.operators import sampling as S
from scorewright.operators.ordered import placed
from scorewright.plans.base import ORACLES, query, rounded, shared, spread, table
from scorewright.sources import io

# --- sampling, limits, windows ---------------------------------------------------------


@query("with r as (select doc_id, row_number() over (order by doc_id) - 1 as rn from documents) select doc_id from r where rn >= 10 and rn < 10 + 300 and (rn - 10) % 3 = 1")
def fil_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL1."""
    return S.window_of(table(spark, sf_dir, "documents"), "doc_id", 10, 300, 1, 3).select("doc_id")


@query("with r as (select doc_id, row_number() over (order by doc_id) - 1 as rn, count(*) over () as n from documents) select doc_id from r where rn < ceil(n * 0.13)")
def fil_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL2."""
    return S.window_of(table(spark, sf_dir, "documents"), "doc_id", 0, 0.13).select("doc_id")


@query("select doc_id, lang from documents where doc_id in (select doc_id from labels where quality = 1) and doc_id not in (select doc_id from labels where toxic = 1) and lower(source) not in ('src1', 'src2') and lang <> 'es'")
def fil_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL3-FIL5, FIL10, JOIN4, JOIN5."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = R.drop_ids(R.keep_ids(docs, labels.where("quality = 1"), "doc_id"), labels.where("toxic = 1"), "doc_id")
    return rows.where(~F.lower("source").isin("src1", "src2") & (F.col("lang") != "es")).select("doc_id", "lang")


@query("with s as (select doc_id, text, case when doc_id % 5 = 0 then 'validation' else 'train' end as split from documents) select doc_id from s where split = 'validation'")
def src_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC3."""
    rows = table(spark, sf_dir, "documents").withColumn("split", F.when(F.col("doc_id") % 5 == 0, "validation").otherwise("train"))
    return S.choose_split(rows).select("doc_id")


@query("select source, doc_id from (select source, doc_id, row_number() over (partition by source order by doc_id) as k from documents) where k <= 5")
def win_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN1."""
    return S.first_n(table(spark, sf_dir, "documents"), ["source"], ["doc_id"], 5).select("source", "doc_id")


@query("select source, doc_id from (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 as k from documents) where k % 7 = 0")
def win_every_kth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN7, WIN8."""
    return S.every_kth(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 7)


@query("with c as (select user_id, event_id, ts, floor(value / 20) as c from events), l as (select *, lag(c) over (partition by user_id order by ts, event_id) as p, row_number() over (partition by user_id order by ts, event_id) as k from c) select user_id, event_id, c from l where k = 1 or c is distinct from p")
def win_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN3."""
    rows = table(spark, sf_dir, "events").withColumn("c", F.floor(F.col("value") / 20))
    return S.changes(rows, ["user_id"], ["ts", "event_id"], ["c"]).select("user_id", "event_id", F.col("c").cast("double").alias("c"))


@query("select conv_id, turn, (sum((role = 'assistant')::int) over w)::bigint as assistant_turn, sum((role = 'assistant')::int) over w > 0 as answered from conversations window w as (partition by conv_id order by turn)")
def win_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN4."""
    return RO.turns_after_first_answer(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "assistant_turn", "answered")


_STEPS = """e as (select event_type as reward, row_number() over (partition by event_type order by event_id) as step, value / 100 as mean, (event_id % 37) / 500.0::double as std from events)"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = placed(table(spark, sf_dir, "events").select(F.col("event_type").alias("reward"), "event_id", "value"), ["reward"], ["event_id"])
    return rows.select("reward", (F.col("pos") + 1).alias("step"), (F.col("value") / 100).alias("mean"), ((F.col("event_id") % 37) / 500.0).alias("std"))


@query(f"""
    with {_STEPS} select reward, step, round(avg(mean) over w, 9) as rolling_mean, round(avg(std) over w, 9) as rolling_std,
      round(avg((std < 0.02 and abs(mean) < 0.05)::int) over w, 9) as saturation, round(case when count(*) over w >= 5 then regr_slope(mean, step) over w else 0 end, 9) as slope from e
    window w as (partition by reward order by step rows between 49 preceding and current row)""")
def win_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN5, WIN6, TRJ11."""
    found = RO.rolling_stats(_steps(spark, sf_dir))
    return rounded(found.select("reward", "step", "rolling_mean", "rolling_std", "saturation", "slope"), 9)


@query(f"""
    with {_STEPS}, f as (select reward, step, mean, std, case reward when 'view' then 0.1 else 0.15 end as base, avg((std < 0.02 and abs(mean) < 0.05)::int) over w as saturation,
        case when count(*) over w >= 5 then regr_slope(mean, step) over w else 0 end as slope, count(*) over w as n from e where reward in ('view', 'click')
      window w as (partition by reward order by step rows between 49 preceding and current row)),
    r as (select reward, step, base, case when n < 5 then 1 else greatest(0.1, least(2.0, std / base)) * (1 - greatest(0, saturation - 0.3) / 0.7) * (1 + greatest(0, least(1, -slope / (abs(mean) + 0.05)))) end as factor from f)
    select reward, step, base::double as base_weight, round(base * factor, 6)::double as raw_weight, round(base * factor * sum(base) over (partition by step) / sum(base * factor) over (partition by step), 6)::double as weight from r""")
def trj_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRJ10."""
    return rounded(RO.adaptive_weights(_steps(spark, sf_dir), {"view": 0.1, "click": 0.15}, {"view": 0.1, "click": 0.15}))


_SIZES = "c as (select lang as kind, source, count(*) as size from documents group by 1, 2)"


@query(f"""
    with {_SIZES}, t as (select *, case kind when 'en' then 200 when 'fr' then 60 end as target, sum(size) over (partition by kind) as total from c),
    q as (select *, case when total <= target then size else greatest(1, floor(target * size / total)) end as quota from t where target is not null),
    u as (select *, sum(quota) over (partition by kind order by size desc, source) as upto from q)
    select kind, source, size, greatest(0, least(quota, target - (upto - quota)))::bigint as quota from u""")
def smp_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP1 (quotas)."""
    return S.quotas(table(spark, sf_dir, "documents").withColumnRenamed("lang", "kind"), "kind", "source", {"en": 200, "fr": 60})


# the order of the draw, in both dialects
_DRAW = "('0x' || substr(md5('42:' || doc_id), 1, 15))::bigint"


def _drawn() -> Column:
    return F.conv(F.substr(F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string")).cast("binary")), F.lit(1), F.lit(15)), 16, 10).cast("bigint")


@query(f"""
    with {_SIZES}, t as (select *, case kind when 'en' then 200 when 'fr' then 60 end as target, sum(size) over (partition by kind) as total from c),
    q as (select *, case when total <= target then size else greatest(1, floor(target * size / total)) end as quota from t where target is not null),
    u as (select *, sum(quota) over (partition by kind order by size desc, source) as upto from q),
    n as (select kind, source, greatest(0, least(quota, target - (upto - quota)))::bigint as quota from u),
    r as (select doc_id, lang as kind, source, row_number() over (partition by lang, source order by {_DRAW}, doc_id) as k from documents)
    select kind, source, doc_id from r join n using (kind, source) where k <= quota""")
def smp_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP1, SMP3 (members; the targets are scaled to a total)."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("kind"), "source")
    return S.stratified(rows, S.scaled_targets({"en": 1000, "fr": 300}, 260), "kind", "source", "doc_id", draw=_drawn()).select("kind", "source", "doc_id")


@query(f"""
    with c as (select lang, count(*) as s from documents group by 1), t as (select *, sum(s) over () as total, max(lang) over () as last from c),
    q as (select lang, s, total, last, round(150 * s / total) as q from t),
    n as (select lang, (case when total <= 150 then s when lang = last then 150 - (select sum(q) from q where lang <> last) else q end)::bigint as n from q),
    r as (select doc_id, lang, row_number() over (partition by lang order by {_DRAW}, doc_id) as k from documents)
    select lang, doc_id from r join n using (lang) where k <= n""")
def smp_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP2 (members)."""
    return S.cap_stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 150, "doc_id", draw=_drawn()).select("lang", "doc_id")


@query()
def smp_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP4; order by Spark's hash."""
    return S.shuffled(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")


@query("with p as (select doc_id as c, row_number() over (order by doc_id) as k from documents), d as (select doc_id, (select string_agg(c, ',' order by c) from (select c from p where k <= 4 and c <> doc_id order by c limit 3)) as shots from documents) select * from d")
def smp_fewshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP5 (first shots; random ones are tested by their properties)."""
    docs = table(spark, sf_dir, "documents")
    found = S.fewshot(docs, docs.select("doc_id", "lang"), 3, mode="first")
    return found.select("doc_id", F.array_join(F.transform("shots", lambda s: s["doc_id"].cast("string")), ",").alias("shots"))


@query()
def smp_fewshot_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP5 (random shots from the whole table; order by Spark's hash, tested by their properties)."""
    docs = table(spark, sf_dir, "documents")
    found = S.fewshot(docs, docs.select("doc_id", "lang"), 3)
    return found.select("doc_id", F.array_join(F.transform("shots", lambda s: s["doc_id"].cast("string")), ",").alias("shots"))


@query("""
    select p_partkey, array_to_string([floor(i * (p_size) / 3.0)::int for i in range(4)], ',') as positions,
      array_to_string(list_transform(string_split(p_type, ' '), lambda w, i: i || '. ' || w), ' ') as numbered from part""")
def smp_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP6, SMP8."""
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", F.array_join(S.uniform_positions(F.col("p_size") + 1, 4).cast("array<string>"), ",").alias("positions"), F.array_join(S.numbered_options(F.split("p_type", " ")), " ").alias("numbered"))


@query()
def smp_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP7, SMP8; order by Spark's hash, tested by its properties."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("options"), F.lit("A").alias("answer"))
    rows = rows.withColumn("without", S.none_of_the_above(F.col("options"), F.col("answer")))
    return S.shuffle_options(rows, "options", "answer", "p_partkey")


@query("select o_custkey, k as repeat from (select distinct o_custkey from orders), (select unnest(range(3)) as k)")
def prj_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ6."""
    return S.repeated(table(spark, sf_dir, "orders").select("o_custkey").distinct(), 3).select("o_custkey", F.col("repeat").cast("long").alias("repeat"))


# --- requests and runs ---------------------------------------------------------------------


@query("""
    with d as (select doc_id, text as c, [lang, source] as ch from documents)
    select doc_id, i - 1 as idx, kind, case kind when 'cond' then c else '' end as context, ch[i] as continuation from d, (select unnest([1, 2]) as i), (select unnest(['cond', 'uncond']) as kind)""")
def prj_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ5, UDF6."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("c"), F.array("lang", "source").alias("ch"))
    return R.choice_requests(docs, "ch", "c", mutual_information=True)


@query("""
    with r as (select o_custkey as doc_id, row_number() over (partition by o_custkey order by o_orderkey) - 1 as idx, -o_totalprice / 1000 as c, -(o_orderkey % 97)::double as u, len(o_orderpriority) as l from orders),
    b as (select doc_id, arg_max(idx, (c, -idx)) as a, arg_max(idx, (c / l, -idx)) as n, arg_max(idx, (c - u, -idx)) as m from r group by 1)
    select doc_id, (a = doc_id % 3)::int::double as acc, (n = doc_id % 3)::int::double as acc_norm, (m = doc_id % 3)::int::double as acc_mi from b""")
def met_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MET22."""
    from pyspark.sql.window import Window

    idx = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = table(spark, sf_dir, "orders").withColumn("idx", idx)
    base = rows.select(F.col("o_custkey").alias("doc_id"), "idx", F.col("o_orderpriority").alias("continuation"), (-F.col("o_totalprice") / 1000).alias("c"), (-(F.col("o_orderkey") % 97)).cast("double").alias("u"))
    both = base.select("doc_id", "idx", F.lit("cond").alias("kind"), F.col("c").alias("ll"), "continuation").union(base.select("doc_id", "idx", F.lit("uncond"), "u", "continuation"))
    gold = base.select("doc_id").distinct().withColumn("gold_idx", F.col("doc_id") % 3)
    return R.choice_scores(both, gold)


_KIND = "case when event_id % 4 = 0 then 'loglikelihood' else 'generate_until' end"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    kwargs = F.create_map(F.lit("temperature"), F.when(F.col("event_id") % 3 == 0, "0.0").when(F.col("event_id") % 3 == 1, "0").otherwise("0.7"), F.lit("n"), F.when(F.col("event_id") % 5 == 0, "2").otherwise("1"), F.lit("other"), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", shared(_KIND).alias("kind"), kwargs.alias("kwargs"), F.when(F.col("event_id") % 7 == 0, "  ").otherwise(F.col("props")).alias("text"), F.when(F.col("event_id") % 8 == 0, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))).alias("ll"))


@query(f"""
    select event_id, {_KIND} = 'loglikelihood' or not (event_id % 3 = 2 or event_id % 5 = 0) as deterministic,
      case when event_id % 4 = 0 then event_id % 8 <> 0 else trim(case when event_id % 7 = 0 then '  ' else props end) <> '' end as valid from events""")
def fil_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL11, FIL12."""
    return _requests(spark, sf_dir).select("event_id", K.deterministic("kind", "kwargs").alias("deterministic"), K.valid_response("kind", "text", "ll").alias("valid"))


@query("""
    select event_id, '{"n":"' || case when event_id % 5 = 0 then '2' else '1' end || '","temperature":"' || case when event_id % 3 = 2 then '0.7' else '0' end || '"}' as kwargs,
      substr(sha256(event_type || chr(0) || user_id), 1, 16) as content, md5('m|' || event_type || '|{"a":"1","b":"' || event_type || '"}') as call, sha256(left(props, 12)) as prefix from events""")
def key_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KEY1, KEY3, KEY5, KEY6."""
    rows = table(spark, sf_dir, "events").select("event_id", "props").join(_requests(spark, sf_dir), "event_id")
    arguments = F.create_map(F.lit("b"), F.col("event_type"), F.lit("a"), F.lit("1"))
    return rows.select("event_id", K.canonical_kwargs("kwargs").alias("kwargs"), K.content_hash("event_type", "user_id").alias("content"), K.call_key(F.lit("m"), "event_type", arguments).alias("call"), K.prefix_hash("props", 12).alias("prefix"))


@query("with h as (select lang, doc_id, sha256('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}') as h from documents) select lang, sha256(string_agg(h, '' order by doc_id)) as task_hash from h group by 1")
def key_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KEY4."""
    rows = table(spark, sf_dir, "documents").select("lang", "doc_id", K.doc_hash(F.struct("doc_id", "lang")).alias("h"))
    return R.task_hash(rows, "lang", "doc_id", "h")


@query("""
    with q as (select event_id, event_type || user_id || (event_id % 3) as k from events), c as (select distinct k from q where event_id % 2 = 0)
    select count(*) filter (k in (select k from c)) as hits, count(*) filter (k not in (select k from c)) as misses from q""")
def join_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN1, SRC6, KEY2."""
    key = K.cache_key(F.lit("generate_until"), "event_type", "user_id", F.col("event_id") % 3, F.create_map(F.lit("n"), F.lit("1")), F.lit(""))
    rows = table(spark, sf_dir, "events").select("event_id", key.alias("cache_key"))
    hits, misses = R.cache_split(rows, rows.where("event_id % 2 = 0").withColumn("response", F.lit("x")))
    return hits.agg(F.count("*").alias("hits")).crossJoin(misses.agg(F.count("*").alias("misses")))  # one row each


@query("""
    with s as (select 0 as shard, user_id as k, min(event_id) as v from events where event_type = 'view' group by 2 union all select 1, user_id, min(event_id) from events where event_type = 'click' group by 2 union all select 2, user_id, min(event_id) from events group by 2)
    select k as cache_key, arg_min(v, shard) as v from s group by 1""")
def set_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET2, SET1."""
    e = table(spark, sf_dir, "events")
    shard = lambda df: df.groupBy(F.col("user_id").alias("cache_key")).agg(F.min("event_id").alias("v"))
    return R.merge_shards([shard(e.where("event_type = 'view'")), shard(e.where("event_type = 'click'")), shard(e)])


@query("""
    with r as (select *, date_trunc('day', ts) as day, 'seed=' || (user_id % 3) || ',size=' || (user_id % 2) as model_args from events where event_id % 7 > 0),
    m as (select * from r where contains(model_args, 'seed=1') and contains(model_args, 'size=0'))
    select event_type, event_id from m where (event_type, day) in (select event_type, max(day) from m group by 1)""")
def src_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5, WIN10: the newest of the runs with the wanted arguments and no limit."""
    args = F.concat(F.lit("seed="), (F.col("user_id") % 3).cast("string"), F.lit(",size="), (F.col("user_id") % 2).cast("string"))
    rows = table(spark, sf_dir, "events").withColumns({"day": F.date_trunc("day", "ts"), "model_args": args, "limit": F.when(F.col("event_id") % 7 == 0, 10)})
    return R.newest_runs(R.matching_runs(rows, "seed=1,size=0"), "event_type", "day").select("event_type", "event_id")


@query("""
    select o_orderkey as doc_id, string_agg(l_returnflag, ',' order by l_linenumber, l_returnflag) as resps from orders join lineitem on l_orderkey = o_orderkey group by 1""")
def join_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN2: the responses of a document, in the order of their numbers."""
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    responses = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("idx"), F.col("l_returnflag").alias("text"))
    return R.with_responses(docs, responses).select("doc_id", F.array_join("resps", ",").alias("resps"))


@query("select doc_id, coalesce(case when doc_id % 2 = 0 then n_chars / 10.0 end, (upper(trim(lang)) = upper(trim(substr(text, 1, 2))))::int)::double as score from documents")
def src_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4."""
    log = table(spark, sf_dir, "documents").select("doc_id", F.struct(F.when(F.col("doc_id") % 2 == 0, F.col("n_chars") / 10).alias("score")).alias("score"), F.col("lang").alias("pred"), F.substring("text", 1, 2).alias("target"))
    return R.baseline_scores(log)


@query("select c_custkey, coalesce(case n_regionkey when 1 then 0.5 when 2 then 0.25 end, 0.15)::double as eps from customer join nation on c_nationkey = n_nationkey")
def join_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN6, SRC9."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("category", F.col("n_regionkey").cast("string"))
    return R.with_parameters(rows, io.parameter_table(spark, {"1": 0.5, "2": 0.25}), "category", "eps", 0.15).select("c_custkey", "eps")


@query("""
    with f as (select user_id as v, event_id as "at" from events where event_id % 3 = 0),
    s as (select user_id as v, event_id as a, event_id + floor(value)::int * 5 as b from events where event_id % 10 = 1)
    select v, "at", a, b from f join s using (v) where a <= "at" and "at" < b""")
def join_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN7."""
    e = table(spark, sf_dir, "events")
    frames = e.where("event_id % 3 = 0").select(F.col("user_id").alias("v"), F.col("event_id").alias("at"))
    spans = e.where("event_id % 10 = 1").select(F.col("user_id").alias("v"), F.col("event_id").alias("a"), (F.col("event_id") + F.floor("value").cast("int") * 5).alias("b"))
    return R.overlapping(frames, spans, "v", "at", "a", "b")


_GRAMS = "list_distinct([array_to_string(w[k : k + 7], ' ') for k in range(1, len(w) - 6)])"


@query(f"""
    with d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '') as w from documents), b as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '') as w from benchmark),
    g as (select doc_id, unnest({_GRAMS}) as g from d where len(w) >= 8), q as (select item_id, unnest({_GRAMS}) as g from b where len(w) >= 8), n as (select item_id, count(*) as n from q group by 1)
    select doc_id, item_id, count(*) as shared, round(count(*) / any_value(n), 6) as share from g join q using (g) join n using (item_id) group by 1, 2""")
def join_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN13."""
    return rounded(R.contamination(spread(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


_VAL_ID = "case p_partkey % 5 when 0 then 'among' when 1 then 'rotation' when 2 then 'around' when 3 then 'aroundnew' else 'other' end || '_' || p_partkey"


@query(f"""
    select p_partkey, 'user' as role, '<video>' || chr(10) || p_name as content, p_brand as solution, case when p_size % 3 = 0 then 'mca' else 'na' end as answer_type,
      case p_partkey % 5 when 0 then 'among' when 1 then 'rotation' when 4 then 'other' else 'around' end as category, p_name || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'Answer with the option''s letter.' as prompt from part where p_size % 3 < 2""")
def prj_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ1-PRJ4: kinds of no answer type are dropped, which is the feature."""
    raw = table(spark, sf_dir, "part").withColumn("kind", F.element_at(F.array(F.lit("choice"), F.lit("count"), F.lit("odd")), F.col("p_size") % 3 + 1))
    mark = F.when(F.col("p_partkey") % 2 == 0, "<image>\n").otherwise("")
    raw = raw.withColumns({"q": F.concat(mark, "p_name"), "val_id": shared(_VAL_ID), "asked": R.prompt(F.col("p_name"), F.array("p_brand", "p_type"))})
    rows = R.training_messages(raw, "q", "p_brand", "kind", ("choice",), ("count",), keep=("p_partkey", "val_id", "asked"))
    message = F.col("messages")[0]
    return rows.select("p_partkey", message["role"].alias("role"), message["content"].alias("content"), "solution", "answer_type", R.category_of(F.col("val_id")).alias("category"), F.col("asked").alias("prompt"))


@query("select event_type, count(*) filter (value > 50) as high, count(*) filter (value <= 50) as low from events group by 1")
def snk_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK5."""
    rows = table(spark, sf_dir, "events").groupBy("event_type", F.when(F.col("value") > 50, "high").otherwise("low").alias("metric")).agg(F.count("*").alias("score"))
    return io.wide_samples(rows, ["event_type"], ["high", "low"])


# --- rollouts -----------------------------------------------------------------------------


@query("""
    with t as (select conv_id, turn, text, sum(1) over (partition by conv_id order by turn) as k from conversations where role = 'assistant' and text <> '')
    select conv_id, max(k)::bigint as n_turns, '[Rollout: ' || max(k) || ' turns, tools: []]' || string_agg(chr(10) || '--- [Turn ' || k || ': Assistant] ---' || chr(10) || text, chr(10) order by turn) as text from t group by 1""")
def trj_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRJ1."""
    return RO.merge_turns(table(spark, sf_dir, "conversations"))


_ROLL = """case cast(doc_id % 7 as int) when 0 then '' when 1 then '### Step 1: Visual clues' || chr(10) else 'Step 1: look' || chr(10) end || case when doc_id % 3 = 0 then 'Step 2.2 map' || chr(10) else '' end
  || case when doc_id % 5 = 0 then '<tool_call>{"name": "spatial_map", "arguments": {"categories": ["a"], "scene_type": "x", "knowledge_type": "y", "output_format": "z"}}</tool_call>' || chr(10) || 'Step 2: x' || chr(10) || 'Step 4: cross check' || chr(10) else '' end
  || text || chr(10) || case when doc_id % 11 = 0 then 'Step 7 more' || chr(10) else '' end || case when doc_id % 4 = 0 then '' else 'Step 5: final answer' || chr(10) end || case when doc_id % 6 = 0 then 'nothing' else '<Answer> ' || chr(cast(65 + doc_id % 5 as int)) || ' </Answer>' end"""


def _rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(spark, sf_dir, "documents").select("doc_id", shared(_ROLL).alias("t"), F.when(F.col("doc_id") % 2 == 0, "A").otherwise("B").alias("solution"))
    return rows.withColumn("calls", K.tool_calls("t"))


_STEP = lambda s: rf"regexp_matches(t, '(?m)(?:#{{1,3}}\s*)?(?:\*{{1,2}})?[Ss]tep\s*{s}(?:\*{{1,2}})?(?:[:\s]|$)')"


@query(rf"""
    with r as (select doc_id, {_ROLL} as t, case when doc_id % 2 = 0 then 'A' else 'B' end as sol from documents),
    f as (select *, regexp_matches(t, '(?is)<Answer>.*?</Answer>') as ans, contains(t, 'tool_call') as tool, {_STEP('1')} as s1, {_STEP('2')} as s2, {_STEP(r'2\.2')} as s22, {_STEP('4')} as s4, {_STEP('5')} as s5,
      len(regexp_extract_all(t, '(?m)(?:#{{1,3}}\s*)?[Ss]tep\s*([6-9]|\d{{2,}})(?:\.\d+)?(?:\s|:|$)')) as extra from r),
    s as (select *, case when not ans or (not tool and not s1 and (s2 or s22 or s4 or s5)) then 0 else
      1 - (not s1)::int * 0.30 - (not s5)::int * 0.20 - (not tool and s22)::int * 0.35 - (tool and not (s22 or s2))::int * 0.10 - (tool and not s4)::int * 0.10 - least(0.2 * extra, 0.4)
      - (s1 and not contains(lower(regexp_extract(t, '(?:#{{1,3}}\s*)?[Ss]tep\s*1(?:\s|:)(.*)', 1)), 'visual'))::int * 0.10 end as structure from f)
    select doc_id, round(structure::double, 6) as structure, case when structure < 0.85 then 0.0 else (coalesce(regexp_extract(t, '<Answer>\s*([A-E])', 1), '') = sol)::int::double end as accuracy from s""")
def trj_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRJ2-TRJ4, TRJ5, TRJ6, JSN1."""
    rows = _rollouts(spark, sf_dir).withColumn("structure", F.round(T.structure_reward("t", "calls"), 6))
    return rows.select("doc_id", "structure", T.accuracy_reward("t", "solution", F.lit("mca"), "structure").alias("accuracy"))


@query(f"select structure_band, count(*) as n, round(avg(gated), 6) as gated_share from (select case when doc_id % 2 = 0 then 'A' else 'B' end as structure_band, (structure < 0.85)::int as gated from ({ORACLES['trj_rewards']})) group by 1")
def trj_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRJ6: share of the rollouts whose accuracy the gate takes."""
    rows = _rollouts(spark, sf_dir).select(F.col("solution").alias("structure_band"), T.gated(F.round(T.structure_reward("t", "calls"), 6)).alias("g"))
    return rows.groupBy("structure_band").agg(F.count("*").alias("n"), F.round(F.avg("g"), 6).alias("gated_share"))


@query(rf"""
    with r as (select doc_id, {_ROLL} as t, (doc_id % 3) / 2.0 as acc from documents)
    select doc_id, round((case when contains(t, 'tool_call') then 0.5 * acc else 0 end)::double, 6) as tool, round((case when length(t) <= 800 then 0 when length(t) <= 2400 then -(length(t) - 800) / 1600 else -1 end)::double, 6) as length from r""")
def trj_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRJ7, TRJ8."""
    rows = _rollouts(spark, sf_dir).withColumn("acc", F.col("doc_id") % 3 / 2.0)
    return rounded(rows.select("doc_id", T.tool_reward("calls", "acc").alias("tool"), T.length_penalty("t", budget=100, most=300).alias("length")))


@query()
def trj_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRJ9 over the rewards of merged conversations."""
    merged = RO.merge_turns(table(spark, sf_dir, "conversations")).withColumn("calls", K.tool_calls("text"))
    rows = merged.withColumn("structure", T.structure_reward("text", "calls"))
    rows = rows.withColumn("accuracy", T.accuracy_reward("text", F.lit("A"), F.lit("mca"), "structure"))
    rows = rows.withColumns({"tool": T.tool_reward("calls", "accuracy"), "length": T.length_penalty("text")})
    return rounded(rows.select("conv_id", T.total_reward("structure", "accuracy", "tool", "length").alias("total")))
