"""Requests, cached responses and runs: joins and set operations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewright.functions.extract import _c
from scorewright.functions.keys import valid_response
from scorewright.sources.staging import staged


def choice_requests(docs: DataFrame, choices: str, context: str, key: str = "doc_id", mutual_information: bool = False) -> DataFrame:
    """One request per choice, ``key, idx, kind, context, continuation``; with
    mutual information also one without context per choice."""
    rows = docs.select(key, F.col(context).alias("context"), F.posexplode(choices).alias("idx", "continuation"))
    cond = rows.select(key, "idx", F.lit("cond").alias("kind"), "context", "continuation")
    if not mutual_information:
        return cond
    return cond.union(rows.select(key, "idx", F.lit("uncond").alias("kind"), F.lit("").alias("context"), "continuation"))


def choice_scores(responses: DataFrame, gold: DataFrame, key: str = "doc_id", higher_is_likelier: bool = True) -> DataFrame:
    """Per document: whether the likeliest choice, the likeliest per character
    and the one with most mutual information are the gold one.

    ``responses`` has key, idx, kind, ll and continuation; ``gold`` key and
    gold_idx.  Ties go to the lower index.
    """
    sign = 1 if higher_is_likelier else -1
    both = responses.groupBy(key, "idx").agg(
        F.max(F.when(F.col("kind") == "cond", sign * F.col("ll"))).alias("c"),
        F.max(F.when(F.col("kind") == "uncond", sign * F.col("ll"))).alias("u"),
        F.max(F.length("continuation")).alias("len"),
    )
    best = lambda v: F.max_by("idx", F.struct(v.alias("v"), (-F.col("idx")).alias("i")))
    per = both.groupBy(key).agg(
        best(F.col("c")).alias("acc"), best(F.col("c") / F.greatest("len", F.lit(1))).alias("acc_norm"),
        best(F.col("c") - F.col("u")).alias("acc_mi"), F.max(F.col("u").isNotNull()).alias("_mi"),
    )
    hit = lambda c: (F.col(c) == F.col("gold_idx")).cast("double")
    return per.join(gold, key).select(key, hit("acc").alias("acc"), hit("acc_norm").alias("acc_norm"), F.when(F.col("_mi"), hit("acc_mi")).alias("acc_mi"))


def cache_split(requests: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """Requests with a cached response, and those without one."""
    known = cache.select(key, "response").dropDuplicates([key])
    return requests.join(known, key), requests.join(known, key, "left_anti")


def cacheable(responses: DataFrame, kind: str = "kind", text: str = "text", ll: str = "ll", deterministic: str = "deterministic") -> DataFrame:
    """Responses worth keeping: deterministic and valid."""
    return responses.where(F.col(deterministic) & valid_response(kind, text, ll))


def merge_shards(shards: list[DataFrame], key: str = "cache_key") -> DataFrame:
    """Union of cache shards, the first shard that has a key wins."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (s.withColumn("_shard", F.lit(k)) for k, s in enumerate(shards)))
    columns = [c for c in rows.columns if c not in (key, "_shard")]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct("_shard", *columns)).alias("_row"))
    return first.select(key, "_row.*")


def matching_runs(log: DataFrame, model_args: str = "", model: str | None = None, limited: bool = False, args: str = "model_args", limit: str = "limit") -> DataFrame:
    """Rows of the runs that may be replayed: of the model, if one is named,
    with every wanted argument (comma-joined) in theirs, and without a limit
    unless ``limited``."""
    rows = log if model is None else log.where(F.col("model") == model)
    for wanted in filter(None, model_args.split(",")):
        rows = rows.where(F.col(args).contains(wanted))
    return rows if limited else rows.where(F.col(limit).isNull())


def newest_runs(log: DataFrame, task: str = "task", time: str = "time") -> DataFrame:
    """The rows of each task's newest run."""
    newest = log.groupBy(task).agg(F.max(time).alias("_newest"))
    return log.join(newest, task).where(F.col(time) == F.col("_newest")).drop("_newest")


def with_responses(docs: DataFrame, responses: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with their responses as an array in the order of idx."""
    lists = responses.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("idx", "text"))).alias("_r"))
    return docs.join(lists, key).withColumn("resps", F.transform("_r", lambda r: r["text"])).drop("_r")


def baseline_scores(log: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, score`` of a saved sample log: the score column, else a struct's
    score, else whether prediction and target agree in upper case."""
    kinds = dict(log.dtypes)
    options: list[Column] = []
    if "score" in kinds:
        options.append(F.col("score.score" if kinds["score"].startswith("struct") else "score").try_cast("double"))
    if "pred" in kinds and "target" in kinds:
        options.append((F.upper(F.trim("pred")) == F.upper(F.trim("target"))).cast("double"))
    return log.select(key, F.coalesce(*options).alias("score"))


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not listed: frames to skip, media that is missing."""
    return df.join(ids.select(key), key, "left_anti")


def with_parameters(df: DataFrame, table: DataFrame, key: str, value: str, default: float) -> DataFrame:
    """``df`` with a category's parameter, or the default.  Spark broadcasts
    the table if its size is below its own threshold."""
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


#: Levels of the dyadic tree over whole numbers.
LEVELS = 62


def dyadic_cover(start: Column, end: Column) -> Column:
    """Nodes ``level, node`` of the binary tree over the whole numbers that
    together cover start..end-1: at most two for each level, so their number is
    logarithmic in the length."""
    node = lambda k, n: F.struct(k.cast("int").alias("level"), n.cast("long").alias("node"))
    start_ = F.struct(start.cast("long").alias("a"), end.cast("long").alias("b"), F.array().cast("array<struct<level:int,node:bigint>>").alias("nodes"))

    def up(s: Column, k: Column) -> Column:
        left, right = (s["a"] < s["b"]) & (s["a"].bitwiseAND(F.lit(1)) == 1), (s["a"] < s["b"]) & (s["b"].bitwiseAND(F.lit(1)) == 1)
        taken = F.filter(F.array(F.when(left, node(k, s["a"])), F.when(right, node(k, s["b"] - 1))), lambda x: x.isNotNull())
        a, b = s["a"] + left.cast("long"), s["b"] - right.cast("long")
        return F.struct(F.shiftright(a, 1).alias("a"), F.shiftright(b, 1).alias("b"), F.concat(s["nodes"], taken).alias("nodes"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start_, up)["nodes"]


def overlapping(points: DataFrame, spans: DataFrame, by: str, at: str, start: str, end: str) -> DataFrame:
    """Pairs with start <= at < end inside ``by``.

    Each span is listed under the nodes of its dyadic cover, a point probes the
    ancestors of its whole number at the levels that spans use (at most 63,
    read by the driver): an equi join, whatever the lengths of the spans, with
    the exact test behind it.  Null ends or places match nothing.
    """
    nodes = dyadic_cover(F.floor(start), F.ceil(F.col(end).cast("double")) if dict(spans.dtypes)[end] in ("double", "float") else F.col(end))
    listed = spans.where(F.col(start) < F.col(end)).withColumn("_n", F.explode(nodes)).withColumns({"_level": F.col("_n.level"), "_node": F.col("_n.node")}).drop("_n")
    levels = sorted(r[0] for r in listed.select("_level").distinct().collect())
    if not levels:
        levels = [0]
    probes = points.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*(F.lit(k).cast("int") for k in levels))))
    probes = probes.withColumn("_node", F.expr(f"shiftright(cast(floor(`{at}`) as bigint), _level)"))
    return probes.join(listed, [by, "_level", "_node"]).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_level", "_node")


#: Bits of the filter that corpus n-grams pass before they become rows, as a power of two: one row of 2 MB.
FILTER_BITS = 24


def contamination(corpus: DataFrame, queries: DataFrame, n: int = 8, corpus_id: str = "doc_id", query_id: str = "item_id", text: str = "text") -> DataFrame:
    """Pairs that share word n-grams: ``corpus_id, query_id, shared, share``
    (of the query's distinct n-grams).

    Distinct n-grams of each side are joined by their 64-bit hash, made of the
    hashes of their words.  Before the corpus side becomes rows, its n-grams
    pass a bit set of the queries' hashes, a row of fixed size: what no query
    has is neither exploded nor shuffled.  The queries are the small side and
    Spark decides by their size how to join; an n-gram that most documents
    have meets only the queries that have it.  Null texts have no n-grams.
    """

    def hashes(df: DataFrame, key: str) -> DataFrame:
        words = F.filter(F.split(F.lower(F.col(text)), r"[^a-z0-9\x{80}-\x{10FFFF}]+"), lambda w: w != "")
        rows = df.select(F.col(key), F.transform(words, lambda w: F.xxhash64(w)).alias("_w")).where(F.size("_w") >= n)
        made = F.transform(F.sequence(F.lit(0), F.size("_w") - n), lambda i: F.xxhash64(*(F.get("_w", i + k) for k in range(n))))
        return rows.select(key, made.alias("_g"))

    asked = staged(hashes(queries, query_id).select(query_id, F.explode(F.array_distinct("_g")).alias("_g")), "asked")
    sizes = asked.groupBy(query_id).agg(F.count("*").alias("_n"))
    place = lambda g: F.shiftrightunsigned(g, 64 - FILTER_BITS)
    words = asked.select(place(F.col("_g")).alias("_at")).groupBy(F.shiftrightunsigned("_at", 6).cast("int").alias("_k"))
    bits = words.agg(F.expr("bit_or(shiftleft(1L, cast(_at & 63 as int)))").alias("_bits"))
    every = asked.sparkSession.range(1 << (FILTER_BITS - 6)).join(bits, F.col("id") == F.col("_k"), "left")
    table = every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("_bits", F.lit(0).cast("long")).alias("_bits")))).alias("_set"))
    table = staged(table.select(F.transform("_set", lambda x: x["_bits"]).alias("_set")), "filter")
    known = lambda g: F.expr("0L") != F.get("_set", F.shiftrightunsigned(place(g), 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), place(g).bitwiseAND(F.lit(63)).cast("int")))
    kept = hashes(corpus, corpus_id).crossJoin(F.broadcast(table)).select(corpus_id, F.array_distinct(F.filter("_g", known)).alias("_g"))  # one row of 2 MB
    grams = kept.select(corpus_id, F.explode("_g").alias("_g"))
    shared = grams.join(asked, "_g").groupBy(corpus_id, query_id).agg(F.count("*").alias("shared"))
    return shared.join(sizes, query_id).select(corpus_id, query_id, "shared", (F.col("shared") / F.col("_n")).alias("share"))


def task_hash(samples: DataFrame, task: str, order: str, digest: str) -> DataFrame:
    """SHA-256 of a task's sample hashes in order.

    The samples of a task are sorted by Spark, which spills, and pass a running
    hash batch by batch, so a task of any size needs the memory of a batch.
    (The digest is over their concatenation, so one task must read them all.)
    Null hashes are left out.
    """
    rows = samples.select(F.col(task).alias("task"), F.col(order).alias("order"), F.col(digest).alias("digest"))
    rows = rows.repartition("task").sortWithinPartitions("task", "order", "digest").select("task", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(tasks: list, hashes: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(tasks, kind), pa.array(hashes, pa.string())], names=["task", "task_hash"])

        at, state = None, None
        for batch in batches:
            kind, tasks, hashes = batch.schema.field(0).type, [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or name != at:
                    if state is not None:
                        tasks.append(at)
                        hashes.append(state.hexdigest())
                    at, state = name, hashlib.sha256()
                if text is not None:
                    state.update(text.encode())
            if tasks:
                yield done(tasks, hashes)
        if state is not None:
            yield done([at], [state.hexdigest()])

    return rows.mapInArrow(run, T.StructType([rows.schema["task"], T.StructField("task_hash", T.StringType())])).toDF(task, "task_hash")


def training_messages(raw: DataFrame, question: str = "question", answer: str = "answer", kind: str = "question_type", choice: tuple[str, ...] = (), number: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw questions as training rows: messages, solution, answer_type (mca for
    the choice kinds, na for the number kinds) and the columns in ``keep``;
    other kinds are dropped."""
    asked = F.concat(F.lit("<video>\n"), F.regexp_replace(_c(question), r"^<(image|video)>\n", ""))
    answer_type = F.when(F.col(kind).isin(*choice), "mca").when(F.col(kind).isin(*number), "na")
    messages = F.array(F.struct(F.lit("user").alias("role"), asked.alias("content")))
    return raw.select(messages.alias("messages"), F.col(answer).alias("solution"), F.col(kind).alias("question_type"), answer_type.alias("answer_type"), *keep).where("answer_type is not null")


def prompt(question: Column, options: Column, post: str = "Answer with the option's letter.") -> Column:
    """Question, lettered options and closing line."""
    lines = F.transform(options, lambda o, k: F.concat(F.chr(k + 65), F.lit(". "), o))
    return F.concat_ws("\n", question, F.array_join(lines, "\n"), F.lit(post))


def category_of(val_id: Column) -> Column:
    """Category by the first part of an id."""
    first = F.split_part(val_id, F.lit("_"), F.lit(1))
    return F.when(first.isin("among", "rotation"), first).when(first.isin("around", "aroundnew"), "around").otherwise("other")
