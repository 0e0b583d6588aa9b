"""Score aggregates and their standard errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.operators import aggregate as A
from scorewright.operators import captions as C
from scorewright.operators import stats
from scorewright.plans.base import query, rounded, spread, table

# line items as scored samples: right if the discount is above 5 %
_S = """s as (select l_returnflag as category, l_linestatus as status, l_orderkey as cluster, l_discount as v, l_quantity as w,
              (l_discount > 0.05)::int::double as score from lineitem)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.select(
        F.col("l_returnflag").alias("category"),
        F.col("l_linestatus").alias("status"),
        F.col("l_orderkey").alias("cluster"),
        F.col("l_discount").alias("v"),
        F.col("l_quantity").alias("w"),
        (F.col("l_discount") > 0.05).cast("double").alias("score"),
    )


@query(f"""
    with {_S}, m as (select category, count(*) as n, avg(score) as mean, stddev_samp(score) as sd from s group by 1),
    d as (select s.category, cluster, sum(score - mean) as t, sum((score - mean) * (score - mean)) as q
          from s join m using (category) group by 1, 2),
    c as (select category, sum(t * t - q) as extra from d group by 1)
    select category, n, round(mean, 6) as mean, round(sd / sqrt(n), 6) as stderr,
           round(sqrt(sd * sd / n + extra / (n * n)), 6) as stderr_clustered
    from m join c using (category)""")
def score_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG1, STA1-STA3."""
    found = stats.clustered_stderr(_scores(spark, sf_dir), ["category"], "score", "cluster")
    return rounded(found.select("category", "n", "mean", "stderr", "stderr_clustered"))


flagship = score_by_flag


@query(f"""
    with {_S} select category, round(avg(v), 6) as mean, round(exp(-avg(v)), 6) as perplexity, round(sum(v) / sum(w), 6) as weighted_mean,
      round(exp(-sum(v) / sum(w)), 6) as weighted_perplexity, round(-sum(v) / sum(w) / ln(2), 6) as bits_per_byte,
      round(stddev_samp(v), 6) as stddev, round(stddev_samp(v) / sqrt(count(v)), 6) as stderr from s group by 1""")
def agg_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG1, AGG3-AGG5, STA1."""
    names = ["mean", "perplexity", "weighted_mean", "weighted_perplexity", "bits_per_byte", "stddev", "stderr"]
    found = _scores(spark, sf_dir).groupBy("category").agg(*(A.AGGREGATES[n](F.col("v"), F.col("w")).alias(n) for n in names))
    return rounded(found)


@query("""
    with r as (select l_returnflag as category, l_extendedprice as v, row_number() over (partition by l_returnflag order by l_extendedprice) as k,
                      count(*) over (partition by l_returnflag) as n from lineitem)
    select category, v from r where k = n // 2 + 1""")
def agg_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG2."""
    return A.score(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("category"), F.col("l_extendedprice").alias("v")), ["category"], "v", "median")


_LABELS = """g as (select d.lang, quality as gold, (n_chars > 1500)::int as pred, toxic from documents d join labels l using (doc_id))"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return both.select("lang", F.col("quality").alias("gold"), (F.col("n_chars") > 1500).cast("int").alias("pred"), "toxic")


@query(f"""
    with {_LABELS}, c as (select lang, count(*) as n, count(*) filter (gold = 1 and pred = 1) as tp, count(*) filter (gold <> 1 and pred = 1) as fp,
      count(*) filter (gold = 1 and pred <> 1) as fn, count(*) filter (gold = pred) as ok from g group by 1)
    select lang, n, round(ok / n, 6) as accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision,
      round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1,
      round((tp + fn) / n, 6) as gold_ratio, round((tp + fp) / n, 6) as pred_ratio from c""")
def agg_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG6, AGG15."""
    return rounded(A.confusion_metrics(_labelled(spark, sf_dir), ["lang"], "gold", "pred"))


@query(f"""
    with {_LABELS}, c as (select lang, count(*) filter (gold = 1 and pred = 1)::double as tp, count(*) filter (gold = 0 and pred = 1)::double as fp,
      count(*) filter (gold = 1 and pred = 0)::double as fn, count(*) filter (gold = 0 and pred = 0)::double as tn from g group by 1)
    select lang, round(case when (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0
      then (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) else 0 end, 6) as mcc from c""")
def agg_matthews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG7."""
    return rounded(A.matthews(_labelled(spark, sf_dir), ["lang"], "gold", "pred"))


@query("""
    with p as (select label, list_transform(embedding, lambda e: (e + 1)::double / 2) as p from embeddings)
    select label, round(avg(list_sum([(p[i + 1] - (i = label)::int::double) ** 2 for i in range(len(p))])), 5) as brier from p group by 1""")
def agg_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG8."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda e: (e + F.lit(1).cast("float")).cast("double") / 2).alias("p"))
    return rounded(A.brier(rows, ["label"], "p", "label"), 5)


_GROUPED = "o as (select o_custkey as doc, o_orderkey as id, o_orderpriority as answer, (o_orderstatus = 'F') as ok, o_orderdate, row_number() over (partition by o_custkey order by o_orderkey) - 1 as repeat from orders)"


def _repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("answer"), (F.col("o_orderstatus") == "F").alias("ok"), number.alias("repeat")
    )


@query(f"""
    with {_GROUPED}, g as (select doc % 7 as part, doc, min(ok::int) as m from o group by 1, 2)
    select part, round(avg(m), 6) as all_correct, count(*) as n_groups from g group by 1""")
def agg_all_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG14."""
    return rounded(A.all_correct(_repeats(spark, sf_dir).withColumn("part", F.col("doc") % 7), ["part"], ["doc"], "ok"))


@query(f"""
    with {_GROUPED}, g as (select answer, doc, sum(ok::int) as s, count(*) as n from o group by 1, 2)
    select answer, round(100 * sum(s) / sum(n), 6) as acc, round(100 * avg((s = n)::int), 6) as acc_plus,
      round(100 * (sum(s) / sum(n) + avg((s = n)::int)), 6) as score from g group by 1""")
def agg_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG16."""
    return rounded(A.paired_score(_repeats(spark, sf_dir), "answer", "doc", "ok"))


@query(f"""
    with {_GROUPED}, q as (select *, 'Q' || (id % 500) || case when id % 2 = 0 then '-flip' else '' end || '-' || (id % 3) as qid from o),
    k as (select answer, ok, regexp_replace(qid, '-\\d+$', '') as a, regexp_replace(qid, '-flip', '') as b,
                 regexp_replace(regexp_replace(qid, '-\\d+$', ''), '-flip', '') as c, id % 100 as m from q)
    select 'circular' as kind, answer, round(avg(x), 6) as all_correct, count(*) as n_groups from (select answer, a, min(ok::int) as x from k group by 1, 2) group by 2
    union all select 'flip', answer, round(avg(x), 6), count(*) from (select answer, b, min(ok::int) as x from k group by 1, 2) group by 2
    union all select 'both', answer, round(avg(x), 6), count(*) from (select answer, c, min(ok::int) as x from k group by 1, 2) group by 2
    union all select 'modulo', answer, round(avg(x), 6), count(*) from (select answer, m, min(ok::int) as x from k group by 1, 2) group by 2""")
def agg_circular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG17, AGG18."""
    flip = F.when(F.col("id") % 2 == 0, "-flip").otherwise("")
    rows = _repeats(spark, sf_dir).withColumn("qid", F.concat(F.lit("Q"), F.col("id") % 500, flip, F.lit("-"), F.col("id") % 3))
    keys = {"circular": A.variant_key("qid"), "flip": A.variant_key("qid", False, True), "both": A.variant_key("qid", True, True), "modulo": A.modulo_key("id", 100)}
    out = None
    for kind, key in keys.items():
        part = A.circular(rows, key, ["answer"], "ok").select(F.lit(kind).alias("kind"), "answer", "all_correct", "n_groups")
        out = part if out is None else out.union(part)
    return rounded(out)


@query(f"""
    with {_GROUPED} select round(avg(ok::int), 6) as accuracy,
      (select round(avg(x), 6) from (select min(ok::int) as x from o group by doc, answer)) as question,
      (select round(avg(x), 6) from (select min(ok::int) as x from o group by doc)) as figure from o""")
def agg_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG19."""
    return rounded(A.nested_accuracy(_repeats(spark, sf_dir), {"question": ["doc", "answer"], "figure": ["doc"]}, "ok"))


@query("""
    with c as (select p_partkey // 4 as g, p_partkey % 4 // 2 as q, p_partkey % 2 as i, (p_size > 15)::int as ok from part),
    p as (select g, max(ok) filter (q = 0 and i = 0) as a, max(ok) filter (q = 0 and i = 1) as b, max(ok) filter (q = 1 and i = 0) as c,
                 max(ok) filter (q = 1 and i = 1) as d from c group by 1)
    select round(avg((a + b + c + d) / 4), 6) as accuracy, round(avg(((a + b = 2)::int + (c + d = 2)::int) / 2), 6) as question_acc,
      round(avg(((a + c = 2)::int + (b + d = 2)::int) / 2), 6) as image_acc, round(avg((a + b + c + d = 4)::int), 6) as group_acc from p""")
def agg_two_by_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG20."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.floor(k / 4).alias("g"), F.floor(k % 4 / 2).alias("q"), (k % 2).alias("i"), (F.col("p_size") > 15).alias("ok"))
    return rounded(A.two_by_two(rows, "g", "q", "i", "ok"))


@query(f"""
    with {_GROUPED}, v as (select doc, doc % 3 as dataset, doc % 5 as category, min(ok::int) as m from o group by 1, 2, 3)
    select dataset, category, round(avg(m), 6) as mean, count(m) as n from v group by grouping sets ((dataset), (category), ())""")
def agg_multiple_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG21, AGG24."""
    rows = _repeats(spark, sf_dir).groupBy("doc").agg(F.min(F.col("ok").cast("int")).alias("m"))
    rows = rows.withColumns({"dataset": F.col("doc") % 3, "category": F.col("doc") % 5})
    return rounded(A.rollup_scores(rows, ["dataset", "category"], "m"))


@query(f"""
    with {_GROUPED}, r as (select k, o.* from o, (select unnest([2, 4, 8, 16]) as k) where repeat < k),
    votes as (select k, doc, answer, count(*) as n, min(repeat) as f, max(ok::int) as m, sum(ok::int) as s from r group by 1, 2, 3),
    d as (select k, doc, max(m) as c, arg_max(m, n * 1000000 - f) as j, sum(s) / sum(n) as a from votes group by 1, 2)
    select k, round(avg(c), 6) as coverage, round(avg(j), 6) as majority, round(avg(a), 6) as average from d group by 1""")
def agg_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG22."""
    return rounded(A.at_k(_repeats(spark, sf_dir), "doc", "repeat", "answer", "ok", [2, 4, 8, 16]))


@query(f"""
    with {_GROUPED}, d as (select doc % 4 as part, doc, avg(ok::int) as a, var_samp(ok::int) as v, count(*) as n, min(ok::int) as lo, max(ok::int) as hi from o group by 1, 2)
    select part, round(sum(a * n) / sum(n), 6) as expected_acc, round(avg((a > 0.5)::int), 6) as consensus_acc,
      round(avg(v) filter (n > 1), 6) as internal_variance, round(avg((lo = hi)::int), 6) as consistency from d group by 1""")
def agg_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG23."""
    rows = _repeats(spark, sf_dir).withColumns({"part": F.col("doc") % 4, "ok": F.col("ok").cast("int")})
    return rounded(A.stability(rows, ["part"], "doc", "ok"))


@query("""
    with r as (select n_regionkey as region, c_nationkey as nation, c_acctbal as v from customer join nation on c_nationkey = n_nationkey)
    select region, nation, round(avg(v), 4) as mean, count(v) as n from r group by rollup (region, nation)""")
def agg_mapped_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG25."""
    mapping = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("v"))
    return rounded(A.mapped_rollup(rows, "nation", mapping, "region", "v").select("region", "nation", "mean", "n"), 4)


@query("""
    with t as (select o_orderpriority as k, avg((o_totalprice > 150000)::int) as m from orders group by 1),
    g as (select case when k in ('1-URGENT', '2-HIGH') then 'high' else k end as type, avg(m) as mean from t group by 1)
    select type, round(mean, 6) as mean from g union all select null, round(avg(mean), 6) from g""")
def agg_merged_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG26."""
    rows = table(spark, sf_dir, "orders").withColumn("ok", (F.col("o_totalprice") > 150000).cast("int"))
    return rounded(A.merged_types(rows, F.col("o_orderpriority"), {"1-URGENT": "high", "2-HIGH": "high"}, "ok"))


@query("""
    with c as (select o_orderstatus as status, o_orderpriority as p, sum(o_totalprice) as s, count(*) as n from orders group by 1, 2)
    select status, round(avg(s / n), 3) as macro, round(sum(s) / sum(n), 3) as micro from c group by 1""")
def agg_macro_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG27."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), "o_orderpriority", "o_totalprice")
    return rounded(A.macro_micro(rows, ["status"], "o_orderpriority", "o_totalprice"), 3)


@query("""
    with r as (select case when p_size % 9 = 0 then -1 else p_size end as v, unnest(string_split(p_type, ' ')) as keyword from part)
    select keyword, count(*) as n, round(avg(v), 6) as mean from r where v <> -1 group by 1""")
def agg_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG28."""
    rows = table(spark, sf_dir, "part").select(F.split("p_type", " ").alias("k"), F.when(F.col("p_size") % 9 == 0, -1).otherwise(F.col("p_size")).alias("v"))
    return rounded(A.keyword_scores(rows, "k", "v"))


@query("""
    with t as (select lang as split, source as task, avg(n_chars) as m from documents group by 1, 2)
    select split, round(avg(m), 4) as mean, count(*) as n_tasks from t group by rollup (split)""")
def agg_split_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG29."""
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("split"), F.col("source").alias("task"), "n_chars")
    return rounded(A.split_macro(rows, "split", "task", "n_chars"), 4)


@query("""
    with f as (select l_suppkey as doc, case when l_linenumber = 3 then -1 else l_discount end as v, l_quantity as w from lineitem)
    select doc, round(sum(v * w) filter (v >= 0) / sum(w) filter (v >= 0), 6) as weighted_mean, min(v) filter (v >= 0) as least from f group by 1""")
def agg_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG30."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.when(F.col("l_linenumber") == 3, -1).otherwise(F.col("l_discount")).alias("v"), F.col("l_quantity").alias("w"))
    return rounded(A.field_scores(rows, ["doc"], "v", "w"))


@query(f"""
    with {_LABELS}, x as (select lang, case when gold = 1 and pred = 1 then 'corrected' when gold = 1 then 'detected' else 'missed' end as o from g),
    c as (select lang, count(*) as n, count(*) filter (o in ('detected', 'corrected')) as l, count(*) filter (o = 'corrected') as d from x group by 1),
    r as (select lang, n, l / n as a, case when l > 0 then d / l else 0 end as b from c)
    select lang, n, round(a, 6) as detected_share, round(b, 6) as corrected_share, round(a * b, 6) as ref_score, round((a + b) / 2, 6) as m_recall from r""")
def agg_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG31."""
    g = F.col("gold") == 1
    rows = _labelled(spark, sf_dir).withColumn("o", F.when(g & (F.col("pred") == 1), "corrected").when(g, "detected").otherwise("missed"))
    return rounded(A.outcome_shares(rows, ["lang"], "o"))


_BATTLES = """b as (select s.l_suppkey % 8 as model_a, t.l_suppkey % 8 as model_b,
    case when s.l_extendedprice > t.l_extendedprice + 1000 then 'A' when t.l_extendedprice > s.l_extendedprice + 1000 then 'B' else 'tie' end as winner
  from (select l_orderkey, l_suppkey, max(l_extendedprice) as l_extendedprice from lineitem group by 1, 2) s
  join (select l_orderkey, l_suppkey, max(l_extendedprice) as l_extendedprice from lineitem group by 1, 2) t
    on s.l_orderkey = t.l_orderkey and s.l_suppkey < t.l_suppkey)"""


def _battles(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.max("l_extendedprice").alias("p"))
    other = best.select("l_orderkey", F.col("l_suppkey").alias("o"), F.col("p").alias("q"))
    rows = best.join(other, "l_orderkey").where(F.col("l_suppkey") < F.col("o"))
    winner = F.when(F.col("p") > F.col("q") + 1000, "A").when(F.col("q") > F.col("p") + 1000, "B").otherwise("tie")
    return rows.select((F.col("l_suppkey") % 8).cast("string").alias("model_a"), (F.col("o") % 8).cast("string").alias("model_b"), winner.alias("winner"))


@query(f"""
    with {_BATTLES}, r as (select model_a as m, case winner when 'tie' then 0.5 when 'A' then 1 else 0 end as w from b
      union all select model_b, case winner when 'tie' then 0.5 when 'B' then 1 else 0 end from b)
    select m::varchar as model, round(avg(w::double), 6) as win_rate, count(*) as n from r group by 1""")
def agg_win_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG32."""
    return rounded(A.win_rates(_battles(spark, sf_dir)))


@query(f"""
    with {_BATTLES} select model_a::varchar as model_a, round(100 * avg((winner = 'A')::int), 6) as "pct_A", round(100 * avg((winner = 'B')::int), 6) as "pct_B",
      round(100 * avg((winner = 'tie')::int), 6) as pct_tie from b group by 1""")
def agg_label_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG32."""
    return rounded(A.label_shares(_battles(spark, sf_dir), ["model_a"], "winner", ["A", "B", "tie"]))


@query()
def agg_elo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG33; an iteration, tested against its optimality condition."""
    return rounded(A.elo(_battles(spark, sf_dir), anchor="0"), 3)


# names of one to three words, from the beginnings of the benchmark's items; every fourth is no object
_NAMES = r"""items as (select item_id, regexp_extract_all(lower(text), '[\pL\pN]+') as w from benchmark),
    names as (select phrase, 'w' || (k % 23) as word, case when k % 4 < 3 then 'o' || (k % 11) end as object
      from (select array_to_string(w[1 : n], ' ') as phrase, min(item_id * 3 + n) as k from (select item_id, w, unnest([1, 2, 3]) as n from items) where len(w) >= n group by 1)),
    spots as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN]+') as w from documents)),
    runs as (select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as phrase from (select *, unnest([1, 2, 3]) as n from spots) where i + n - 1 <= len(w)),
    hits as (select * from runs join names using (phrase) qualify row_number() over (partition by doc_id, i order by n desc) = 1),
    taken as (select doc_id, list_reduce(list(struct_pack(i := i::bigint, n := n::bigint, word := word, object := object) order by i),
        lambda a, x: case when x.i >= a.i then struct_pack(i := x.i + x.n, words := list_append(a.words, x.word), objects := list_append(a.objects, x.object)) else a end,
        struct_pack(i := 0::bigint, words := []::varchar[], objects := []::varchar[])) as t from hits group by 1),
    kept as (select doc_id, [k for k in range(1, len(t.words) + 1) if not (t.words[k] = 'w6' and list_contains(t.words, 'w9'))] as ks, t from taken),
    said as (select d.doc_id, d.lang, coalesce([t.words[k] for k in ks], []::varchar[]) as words, coalesce([t.objects[k] for k in ks if t.objects[k] is not null], []::varchar[]) as objects
      from documents d left join kept using (doc_id))"""
# what w6 stands for is not meant where w9 is named
_UNLESS = {"w6": "w9"}


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary of the caption queries: ``phrase, word, object``."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(C.WORD), 0)
    rows = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w")).select("item_id", "w", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("n")).where("size(w) >= n")
    rows = rows.groupBy(F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("phrase")).agg(F.min(F.col("item_id") * 3 + F.col("n")).alias("k"))
    named = lambda letter, n: F.concat(F.lit(letter), (F.col("k") % n).cast("string"))
    return rows.select("phrase", named("w", 23).alias("word"), F.when(F.col("k") % 4 < 3, named("o", 11)).alias("object"))


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.caption_objects(spread(spark, sf_dir, "documents"), "doc_id", "text", _names(spark, sf_dir), _UNLESS)


@query(f"""
    with {_NAMES} select doc_id, len(words) as n_words, len(objects) as n_objects, array_to_string(words, ' ') as words, array_to_string(objects, ' ') as objects from said""")
def met_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MET27: what whole documents mention of a dictionary with names of several words."""
    text = lambda c: F.array_join(c, " ").alias(c)
    return _mentions(spark, sf_dir).select("doc_id", F.size("words").alias("n_words"), F.size("objects").alias("n_objects"), text("words"), text("objects"))


@query(f"""
    with {_NAMES}, p as (select a.lang, a.objects as p, list_distinct(coalesce(b.objects, []::varchar[])) as g from said a left join said b on b.doc_id = a.doc_id + 1),
    c as (select lang, len([x for x in p if not list_contains(g, x)]) as wrong, len(p) as np, len(list_intersect(list_distinct(p), g)) as hit, len(g) as ng from p)
    select lang, round(sum(wrong) / sum(np), 6) as object_rate, round(avg((wrong > 0)::int), 6) as caption_rate, round(sum(hit) / sum(ng), 6) as recall from c group by 1""")
def agg_hallucination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MET27, AGG34: the objects of the next document are those of the picture."""
    said = _mentions(spark, sf_dir).select("doc_id", "objects").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    there = said.select((F.col("doc_id") - 1).alias("doc_id"), F.col("objects").alias("there"))
    return rounded(A.hallucination(said.join(there, "doc_id", "left"), ["lang"], "objects", "there"))


@query("""
    with i as (select o_orderpriority as k, greatest(least(a1, b1) - greatest(a0, b0), 0) / (greatest(a1, b1) - least(a0, b0)) as iou from
      (select o_orderpriority, o_custkey % 100 as a0, o_custkey % 100 + 30 as a1, o_orderkey % 90 as b0, o_orderkey % 90 + 40 as b1 from orders))
    select k, round(avg(iou), 6) as miou, round(avg((iou >= 0.3)::int), 6) as r_at_30, round(avg((iou >= 0.5)::int), 6) as r_at_50, round(avg((iou >= 0.7)::int), 6) as r_at_70 from i group by 1""")
def agg_recall_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MET17, AGG35."""
    from scorewright.functions.metrics import span_iou

    a, b = F.col("o_custkey") % 100, F.col("o_orderkey") % 90
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("k"), span_iou(a, a + 30, b, b + 40).alias("iou"))
    return rounded(A.recall_at(rows, ["k"], "iou"))


_SEGMENTS = """gold as (select o_custkey as video, o_orderkey as gold_id, o_orderkey % 90 as a0, o_orderkey % 90 + 30 as a1 from orders where o_orderkey % 2 = 0),
    pred as (select o_custkey as video, o_orderkey as pred_id, o_orderkey % 80 as b0, o_orderkey % 80 + 25 as b1 from orders where o_orderkey % 2 = 1)"""


@query(f"""
    with {_SEGMENTS}, p as (select video, gold_id, pred_id, greatest(least(a1, b1) - greatest(a0, b0), 0) / (greatest(a1, b1) - least(a0, b0)) as iou from gold join pred using (video)),
    t as (select unnest([0.3, 0.5, 0.7, 0.9]) as threshold),
    bp as (select video, pred_id, max(iou) as m from p group by 1, 2), bg as (select video, gold_id, max(iou) as m from p group by 1, 2),
    np as (select video, count(*) as n from pred group by 1), ng as (select video, count(*) as n from gold group by 1),
    pr as (select threshold, avg(h / n) as precision from (select t.threshold, np.video, np.n, count(bp.m) filter (bp.m >= t.threshold) as h from np cross join t left join bp on bp.video = np.video group by 1, 2, 3) group by 1),
    rc as (select threshold, avg(h / n) as recall from (select t.threshold, ng.video, ng.n, count(bg.m) filter (bg.m >= t.threshold) as h from ng cross join t left join bg on bg.video = ng.video group by 1, 2, 3) group by 1)
    select threshold::double as threshold, round(precision, 6) as precision, round(recall, 6) as recall from pr join rc using (threshold)""")
def agg_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG36, JOIN12."""
    from scorewright.functions.metrics import span_iou

    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    gold = orders.where(k % 2 == 0).select(F.col("o_custkey").alias("video"), k.alias("gold_id"), (k % 90).alias("a0"))
    pred = orders.where(k % 2 == 1).select(F.col("o_custkey").alias("video"), k.alias("pred_id"), (k % 80).alias("b0"))
    pairs = gold.join(pred, "video").withColumn("iou", span_iou("a0", F.col("a0") + 30, "b0", F.col("b0") + 25))
    n = lambda df: df.groupBy("video").agg(F.count("*").alias("n"))
    return rounded(A.detection(pairs, n(gold), n(pred), "iou", [0.3, 0.5, 0.7, 0.9]))


@query("""
    with f as (select lang, unnest([n_chars > 500, n_chars > 1500, n_chars % 2 = 0]) as f from documents)
    select lang, round(avg(f::int), 6) as accuracy from f group by 1""")
def agg_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG37."""
    n = F.col("n_chars")
    rows = table(spark, sf_dir, "documents").select("lang", F.array(n > 500, n > 1500, n % 2 == 0).alias("f"))
    return rounded(A.flattened_accuracy(rows, ["lang"], "f"))


_TREE = """r as (select 'n' || c_nationkey as task, 'acctbal' as metric, 'none' as filter, avg(c_acctbal) as value, count(*) as n from customer group by 1),
    g as (select 'r' || n_regionkey as root, 'n' || n_nationkey as leaf from nation union all select 'all', 'n' || n_nationkey from nation)"""


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nation = table(spark, sf_dir, "nation")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    results = table(spark, sf_dir, "customer").groupBy(name("n", "c_nationkey").alias("task")).agg(F.avg("c_acctbal").alias("value"), F.stddev_samp("c_acctbal").alias("sd"), F.count("*").alias("n"))
    results = results.select("task", F.lit("acctbal").alias("metric"), F.lit("none").alias("filter"), "value", "sd", "n")
    edges = nation.select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child"))
    return results, edges.union(table(spark, sf_dir, "region").select(F.lit("all").alias("parent"), name("r", "r_regionkey").alias("child")))


@query(f"with {_TREE} select root, metric, filter, round(sum(value * r.n) / sum(r.n), 4) as value, sum(r.n)::bigint as n from r join g on task = leaf group by 1, 2, 3")
def agg_groups_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG38, JOIN11."""
    results, edges = _tree(spark, sf_dir)
    return rounded(A.group_scores(results, A.flatten_groups(edges)), 4)


@query(f"with {_TREE} select root, metric, filter, round(avg(value), 4) as value, sum(r.n)::bigint as n from r join g on task = leaf group by 1, 2, 3")
def agg_groups_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG38."""
    results, edges = _tree(spark, sf_dir)
    return rounded(A.group_scores(results, A.flatten_groups(edges), weight_by_size=False), 4)


@query("select lang, source, count(*) as n from documents group by rollup (lang, source)")
def agg_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG39."""
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("n"))


@query("""
    select event_type, round(sum(value), 3) as total_tokens, round(sum(value * 0.01 + 1), 3) as total_seconds,
      round(sum(value) / sum(value * 0.01 + 1), 5) as tokens_per_second, round(avg(value * 0.01 + 1), 5) as mean_latency from events group by 1""")
def agg_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG40."""
    rows = table(spark, sf_dir, "events").withColumn("s", F.col("value") * 0.01 + 1)
    found = A.throughput(rows, ["event_type"], "value", "s")
    return found.select("event_type", *(F.round(c, 3).alias(c) for c in ("total_tokens", "total_seconds")), *(F.round(c, 5).alias(c) for c in ("tokens_per_second", "mean_latency")))


@query("""
    with r as (select user_id, value, (event_type = 'error')::int as f, (event_type = 'view')::int as m, row_number() over (partition by user_id order by value) as k,
               count(*) over (partition by user_id) as n from events)
    select user_id, max(value) filter (k = floor(0.95 * (n - 1)) + 1) as p95, round(avg(f), 6) as failure_rate, round(avg(m), 6) as limit_rate, count(*) as n from r group by 1""")
def agg_request_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG41."""
    kind = F.col("event_type")
    found = A.request_health(table(spark, sf_dir, "events"), ["user_id"], "value", kind == "error", kind == "view")
    return found.select("user_id", "p95", F.round("failure_rate", 6).alias("failure_rate"), F.round("limit_rate", 6).alias("limit_rate"), "n")


@query("select n_regionkey as g, case when min(n_nationkey % 2) = max(n_nationkey % 2) then min(n_nationkey % 2) end as direction from nation group by 1")
def agg_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG42."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("g"), (F.col("n_nationkey") % 2).alias("d"))
    return A.common_direction(rows, ["g"], "d")


@query("""
    with a as (select o_orderkey, o_orderpriority as p, (o_totalprice > 100000) as x from orders), b as (select o_orderkey, (o_custkey % 3 > 0) as y from orders)
    select p, round(avg((x and y)::int), 6) as dual_acc, count(*) as n from a join b using (o_orderkey) group by rollup (p)""")
def agg_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG43."""
    orders = table(spark, sf_dir, "orders")
    a = orders.select("o_orderkey", F.col("o_orderpriority").alias("p"), (F.col("o_totalprice") > 100000).alias("ok"))
    b = orders.select("o_orderkey", (F.col("o_custkey") % 3 > 0).alias("ok"))
    return rounded(A.dual_accuracy(a, b, "o_orderkey", "p", "ok"))


@query("""
    with r as (select event_type, case when event_id % 11 = 0 then -999 else value end as m, user_id % 10 + 1.0 as f from events)
    select event_type, round(100 * avg(m) / avg(f), 4) as relative from r where m <> -999 group by 1""")
def agg_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG44."""
    rows = table(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 11 == 0, -999.0).otherwise(F.col("value")).alias("m"), (F.col("user_id") % 10 + 1.0).alias("f"))
    return rounded(A.relative_score(rows, ["event_type"], "m", "f"), 4)


@query("""
    with r as (select p_size > 10 as g, p_retailprice > 1200 as p, case when p_size > 10 then p_size / 60 else -1 end as f1, [p_size % (k + 2) for k in range(10)] as tp, [p_size % (k + 3) for k in range(10)] as fp, [p_size % (k + 4) for k in range(10)] as fn from part),
    w as (select avg(f1) filter (f1 >= 0) as macro_f1, count(*) filter (g and p) as a, count(*) filter (not g and not p) as b, count(*) filter (not g and p) as c, count(*) filter (g and not p) as d from r),
    s as (select k, sum(tp[k]) as tp, sum(fp[k]) as fp, sum(fn[k]) as fn from r, (select unnest(range(1, 11)) as k) where g group by 1),
    m as (select *, coalesce((a::double * b - c::double * d) / nullif(sqrt((a + c)::double * (a + d) * (b + c) * (b + d)), 0), 0) as mcc, (select avg(2 * tp / (2 * tp + fp + fn)) from s) as f from w)
    select a, b, c, d, round(mcc, 6) as mcc, round(macro_f1, 6) as macro_f1, round(f, 6) as pmf1, round(100 * mcc * f, 5) as gated_f1 from m""")
def agg_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG45."""
    n = lambda j: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.col("p_size") % (k + j))
    rows = table(spark, sf_dir, "part").select((F.col("p_size") > 10).alias("g"), (F.col("p_retailprice") > 1200).alias("p"), n(2).alias("tp"), n(3).alias("fp"), n(4).alias("fn"), F.when(F.col("p_size") > 10, F.col("p_size") / 60).otherwise(-1.0).alias("f1"))
    found = A.presence_metrics(rows, "g", "p", "tp", "fp", "fn", "f1")
    return found.select("a", "b", "c", "d", F.round("mcc", 6).alias("mcc"), F.round("macro_f1", 6).alias("macro_f1"), F.round("pmf1", 6).alias("pmf1"), F.round("gated_f1", 5).alias("gated_f1"))


@query("select lang, source, round(avg(n_chars), 4) as mean, count(n_chars) as n from documents group by cube (lang, source)")
def agg_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG46."""
    return rounded(A.subset_means(table(spark, sf_dir, "documents"), "lang", "source", "n_chars"), 4)


@query("""select n_regionkey as "group", c_nationkey as kind, round(sum(c_acctbal), 2) as total from customer join nation on c_nationkey = n_nationkey group by rollup (n_regionkey, c_nationkey)""")
def agg_fixed_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG47."""
    groups = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("kind"), F.col("n_regionkey").alias("group"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("kind"), "c_acctbal")
    return rounded(A.fixed_total(rows, "kind", groups, "c_acctbal"), 2)


@query("""
    with r as (select event_type as kind, user_id % 4 as part, (value > 50)::int as ok from events where event_id % 13 <> 0)
    select kind, part, round(avg(ok), 6) as accuracy, round(sqrt(avg(ok) * (1 - avg(ok)) / count(*)), 6) as stderr, count(*) as n from r group by grouping sets ((kind), (part), ())""")
def agg_binomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG48."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), (F.col("user_id") % 4).alias("part"), (F.col("value") > 50).alias("ok"), "event_id")
    return rounded(A.binomial_accuracy(rows, ["kind", "part"], "ok", F.col("event_id") % 13 == 0))


@query("""
    with t as (select c_nationkey as task, avg(c_acctbal) as m from customer group by 1)
    select case n_regionkey when 0 then 'low' when 1 then 'middle' else 'high' end as tier, round(avg(m), 4) as mean, count(*) as n_tasks
    from t join nation on task = n_nationkey group by rollup (case n_regionkey when 0 then 'low' when 1 then 'middle' else 'high' end)""")
def agg_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG49."""
    tier = F.when(F.col("n_regionkey") == 0, "low").when(F.col("n_regionkey") == 1, "middle").otherwise("high")
    tiers = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("task"), tier.alias("tier"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("task"), "c_acctbal")
    return rounded(A.tier_means(rows, "task", tiers, "c_acctbal"), 4)


@query("""
    with r as (select p_brand as b, p_size % 5 as c, [p_size % 3, p_size % 4] as v, [p_size % 6] as u from part)
    select b, round(avg(case when list_contains(v, c) then 1 when list_contains(u, c) then 0.5 else 0 end), 6) as selection from r group by 1""")
def agg_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG50."""
    s = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("b"), (s % 5).alias("c"), F.array(s % 3, s % 4).alias("v"), F.array(s % 6).alias("u"))
    return rounded(A.selection_score(rows, ["b"], "c", "v", "u"))


@query("""
    with r as (select event_type as k, case when event_id % 7 = 0 then -1 else event_id % 5 + 1 end as v from events)
    select k, round(100 * (avg(v) - 1) / 4, 6) as mean, count(*) as n from r where v >= 0 group by rollup (k)""")
def agg_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG52."""
    v = F.when(F.col("event_id") % 7 == 0, -1).otherwise(F.col("event_id") % 5 + 1)
    return rounded(A.judge_means(table(spark, sf_dir, "events").select(F.col("event_type").alias("k"), v.alias("v")), "k", "v"))


# --- statistics -------------------------------------------------------------------


@query(f"with {_TREE}, s as (select 'n' || c_nationkey as task, stddev_samp(c_acctbal) / sqrt(count(*)) as e, count(*) as n from customer group by 1) select root, round(sqrt(sum((s.n - 1) * e * e * s.n) / (sum(s.n) - count(*)) / sum(s.n)), 5) as pooled_stderr, sum(s.n)::bigint as n from s join g on task = leaf group by 1")
def sta_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA6."""
    results, edges = _tree(spark, sf_dir)
    rows = results.withColumn("stderr", F.col("sd") / F.sqrt("n")).join(A.flatten_groups(edges), F.col("task") == F.col("leaf"))
    return rounded(stats.pooled_stderr(rows, ["root"]), 5)


@query()
def sta_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA7; an ordered fold, tested against plain Python."""
    results, edges = _tree(spark, sf_dir)
    rows = results.withColumns({"stderr": F.col("sd") / F.sqrt("n"), "mean": F.col("value")}).join(A.flatten_groups(edges), F.col("task") == F.col("leaf"))
    return rounded(stats.combined_stderr(rows, ["root"], "task"), 5)


@query()
def sta_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA4, STA5; draws from Spark's hash, tested by their distribution."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"), (F.col("o_totalprice") > 150000).cast("double").alias("v"))
    return rounded(stats.bootstrap(rows, ["s"], "v", ["o_orderkey"], 100))


@query()
def sta_bootstrap_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA4 of an aggregate that is no mean."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("v"))
    return rounded(stats.bootstrap_aggregate(rows, ["s"], ["o_orderkey"], lambda df, by: A.weighted_median(df, by, "v", "weight"), "v", 20, weighted=True), 2)


@query()
def sta_bootstrap_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA4 of F1 and Matthews correlation; draws from Spark's hash, tested against a plain bootstrap."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"), (F.col("o_totalprice") > 150000).alias("g"), (F.col("o_custkey") % 3 == 0).alias("p"))
    both = [stats.bootstrap_sums(rows, ["s"], ["o_orderkey"], A.binary_counters("g", "p"), m, 100).withColumn("metric", F.lit(n)) for n, m in (("f1", A.f1_score()), ("mcc", A.matthews_score()))]
    return rounded(both[0].union(both[1]))


@query()
def sta_bootstrap_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA4 of corpus BLEU over whole documents; draws from Spark's hash, tested against a plain bootstrap."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+"), lambda x: x != "")
    without = lambda end: F.filter(words, lambda x: ~x.endswith(end))
    rows = spread(spark, sf_dir, "documents").select("doc_id", "lang", without("n").alias("c"), F.array(without("e")).alias("refs"))
    return rounded(stats.bootstrap_sums(rows, ["lang"], ["doc_id"], A.bleu_counters("c", "refs"), A.bleu_score(4), 100), 4)


_RUNS = """a as (select o_orderkey as id, o_orderpriority as task, (o_totalprice > 150000)::int::double as score from orders where o_orderkey % 10 > 0),
    b as (select o_orderkey as id, o_orderpriority as task, (o_totalprice > 155000)::int::double as score from orders where o_orderkey % 9 > 0)"""


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    run = lambda keep, least: orders.where(keep).select(k.alias("id"), F.col("o_orderpriority").alias("task"), (F.col("o_totalprice") > least).cast("double").alias("score"))
    return run(k % 10 > 0, 150000), run(k % 9 > 0, 155000)


@query(f"""
    with {_RUNS}, d as (select a.task, a.score - b.score as d from a join b using (id))
    select task, count(*) as n, round(avg(d), 6) as diff, round(stddev_samp(d) / sqrt(count(*)), 6) as stderr, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 5) as t from d group by 1""")
def sta_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN3, STA8 (the tails are tested against tabulated values)."""
    found = stats.paired_ttest(*_runs(spark, sf_dir), "id", ["task"])
    return found.select("task", "n", F.round("diff", 6).alias("diff"), F.round("stderr", 6).alias("stderr"), F.round("t", 5).alias("t"))


@query()
def sta_paired_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA8 with p and interval."""
    return rounded(stats.paired_ttest(*_runs(spark, sf_dir), "id", ["task"]))


_Z = "(1.959963984540054 + 0.8416212335729143)"


@query(f"""
    with {_RUNS}, m as (select count(*) as n, sqrt(greatest(var_samp(a.score) + var_samp(b.score) - 2 * covar_samp(a.score, b.score), 0)) as s from a join b using (id))
    select n, round(s, 6) as std_diff, ceil(({_Z} * s / 0.01) ** 2)::bigint as required_n, round({_Z} * s / sqrt(n), 6) as detectable from m""")
def sta_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA9 (the achieved power is tested by the closed form)."""
    return rounded(stats.power(*_runs(spark, sf_dir), "id", 0.01).drop("power"))


@query(f"""
    with {_RUNS}, x as (select task, avg(score) as value from a group by 1), y as (select task, avg(score) as value from b where task <> '5-LOW' group by 1)
    select coalesce(x.task, y.task) as task, round(x.value, 6) as value_a, round(y.value, 6) as value_b, round(x.value - y.value, 6) as difference from x full join y on x.task = y.task""")
def sta_run_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA10."""
    a, b = (r.groupBy("task").agg(F.avg("score").alias("value")) for r in _runs(spark, sf_dir))
    return rounded(stats.run_differences(a, b.where("task <> '5-LOW'"), ["task"]))
