"""Registered queries of the subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm import chat, decontam, fingerprints, hardneg, langid, lmscore, merkle, packing, secrets, sharding, simhash, substrings, warc
from scorewright.sources.io import read_spread
from scorewright.sources.staging import fresh_path, staged


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that costs more than reading it: one of fewer splits
    than tasks run at once is dealt to as many tasks."""
    return read_spread(spark, f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(_spread(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of nearly equal bytes."""
    found = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), 8)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_spread(spark, sf_dir, "documents"))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives, and what the archives hold."""
    path = fresh_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    found = warc.read_archives(spark, path)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(_spread(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_spread(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all pages; the text model is fitted on labelled documents."""
    model = langid.fit(_table(spark, sf_dir, "documents"))
    pages = _spread(spark, sf_dir, "pages").select(
        "page_id", "url", langid.markup_text(F.col("html")).alias("text"), langid.markup_language(F.col("html")).alias("declared")
    )
    found, (page_id, declared) = langid.identify(pages, model, "text", F.col("declared"), F.col("url"), ["page_id", "declared"])
    return found.select(page_id, declared, "lang", F.round("confidence", 6).alias("confidence"), "text_lang", "host", "n_trigrams")


#: A conversation of control strings only, beside those of the table.
MARKED = "</s>[INST] ok [/INST]"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.sql(
        "select cast(-1 as bigint) conv_id, cast(k as bigint) turn, r role, t text from values (0, 'user', :t), (1, 'assistant', :t) as v(k, r, t)",
        {"t": MARKED},
    )
    return chat.read_back(chat.format_conversations(given.union(marked)))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spread(spark, sf_dir, "documents")
    if docs.rdd.getNumPartitions() != _table(spark, sf_dir, "documents").rdd.getNumPartitions():
        docs = staged(docs.select("doc_id", "text"), "spread")  # rows that were dealt anew must keep their order
    found = lmscore.score_documents(docs)
    words = F.when(F.col("n_words") > 0, F.col("n_words"))
    return found.select(
        "doc_id", "n_words", "n_seen", "n_full", F.round("log_score", 4).alias("log_score"), F.round(F.col("n_full") / words, 6).alias("full_share"),
        F.round(F.col("log_score") / words, 4).alias("mean_log_score"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_spread(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    return merkle.tampered_folds(_table(spark, sf_dir, "documents"), columns).withColumnRenamed("id", "doc_id")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=shifted)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.drop_repeats(_spread(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_sharding": op2_sharding,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_warc_revisits": op4_warc_revisits,
    "op5_fingerprints": op5_fingerprints,
    "op6_simhash": op6_simhash,
    "op7_language_id": op7_language_id,
    "op8_chat_format": op8_chat_format,
    "op9_lm_scores": op9_lm_scores,
    "op10_decontamination": op10_decontamination,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_substring_dedup": op13_substring_dedup,
}

_WARC_SQL = """
with p as (
  select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as h from pages
), d as (
  select page_id, octet_length(encode(body)) as payload_bytes, min(page_id) over (partition by body) as first_id,
         [('0x' || substr(h, 5 * k + 1, 5))::integer for k in range(8)] as parts,
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' as letters
  from p
)
select page_id, payload_bytes,
       array_to_string([letters[1 + v // 32768] || letters[1 + v // 1024 % 32] || letters[1 + v // 32 % 32] || letters[1 + v % 32]
                        for v in parts], '') as payload_digest,
       case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id = first_id then null else first_id end as refers_to
from d"""

_CHAT_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e as (
  select *, regexp_matches(role || chr(10) || text, '</?s>|\[/?INST\]') or regexp_matches(role, '(?s)\\.')
            or regexp_matches(text, '(?s)\\.') as conflict,
         length(regexp_replace(replace(role, '\', '\\'), '([<\[])(/?(s>|INST\]))', '\1\\\2', 'g')) as safe_role,
         length(regexp_replace(replace(text, '\', '\\'), '([<\[])(/?(s>|INST\]))', '\1\\\2', 'g')) as safe_text
  from c
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(22 + case when conflict then safe_role + safe_text else length(role) + length(text) end)::bigint as formatted_chars
from e group by conv_id"""

_WORDS = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_DECONTAM_SQL = r"""
with docs as (
  select doc_id, row_number() over () as r, regexp_extract_all(%s, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), items as (
  select item_id::varchar as item, regexp_extract_all(%s, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), windows as (
  select distinct item, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') as gram, least(10, len(w)) as n
  from (select item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as k from items where len(w) > 0)
), sizes as (select distinct n from windows
), found as (
  select r, k, p.n, item from (
    select r, n, k, array_to_string(w[k : k + n - 1], ' ') as gram
    from (select r, w, n, unnest(range(1, len(w) - n + 2)) as k from docs, sizes where len(w) >= n)) p
  join windows using (gram, n)
), hit as (select r, count(distinct pos) as n_hit from (select r, unnest(range(k, k + n)) as pos from found) group by r
), named as (
  select r, count(distinct item) as n_items, sha256(array_to_string(list_sort(list(distinct item)), ',')) as h from found group by r
)
select doc_id, coalesce(len(w), 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       coalesce(h, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit using (r) left join named using (r)""" % (_WORDS.format("text"), _WORDS.format("text"))

_LM_SQL = r"""
with docs as (
  select doc_id, row_number() over () as r, regexp_extract_all(%s, '[^\x20\x09-\x0D]+') as w from documents
), t as (
  select r, i, w[i] as a, case when i > 1 then w[i - 1] || ' ' || w[i] end as b,
         case when i > 2 then w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] end as c
  from (select r, w, unnest(range(1, len(w) + 1)) as i from docs)
), k as (
  select r, i, count(*) over (partition by a) - count(*) over (partition by a, r) as n1,
         case when b is null then 0 else count(*) over (partition by b) - count(*) over (partition by b, r) end as n2,
         case when c is null then 0 else count(*) over (partition by c) - count(*) over (partition by c, r) end as n3
  from t
), p as (
  select *, lag(n1) over (partition by r order by i) as m1, lag(n2) over (partition by r order by i) as m2,
         count(*) over () - count(*) over (partition by r) as rest
  from k
), s as (
  select r, case when n3 > 0 then ln(n3 / m2)
                 when n2 > 0 then ln(n2 / m1) + (least(i, 3) - 2) * ln(0.4)
                 else ln(greatest(n1, 0.5) / greatest(rest, 1)) + (least(i, 3) - 1) * ln(0.4) end as score, n3 > 0 as seen,
         case least(i, 3) when 1 then n1 when 2 then n2 else n3 end > 0 as whole
  from p
)
select doc_id, coalesce(len(w), 0)::bigint as n_words, coalesce(n_seen, 0)::bigint as n_seen, coalesce(n_full, 0)::bigint as n_full,
       round(coalesce(total, 0), 4) as log_score, round(n_full / nullif(len(w), 0), 6) as full_share, round(total / nullif(len(w), 0), 4) as mean_log_score
from docs left join (select r, sum(score::double) as total, count(*) filter (where seen) as n_seen, count(*) filter (where whole) as n_full from s group by r) using (r)""" % (
    _WORDS.format("text"),
)

_LEAF = "concat(" + ", ".join(f"coalesce(octet_length(encode({c}::varchar)) || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
_CRC32 = """list_reduce(flatten([[4294967295], flatten([[ord(c), -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(doc_id::varchar, '')])]),
             lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end)"""


def _merkle_level(tree: str, k: int) -> str:
    """Parents of level ``k`` over those of the level before, where more than one node remains."""
    return f"""{tree}{k} as (
  select t, p // 8 as p, sha256(string_agg(h, '' order by p)) as h
  from (select *, count(*) over (partition by t) as n from {tree}{k - 1}) where n > 1 group by t, p // 8)"""


def _merkle_fold(name: str, before: str, tree: str, k: int) -> str:
    """Rows ``r`` with place ``p`` one level up: siblings added to the proof, own digest folded."""
    return f"""{name}{k} as (
  select a.r, a.t, a.p // 8 as p, any_value(a.proof) || coalesce(string_agg(b.h, '' order by b.p) filter (b.p <> a.p), '') as proof,
         case when count(c.t) = 0 then any_value(a.f) else sha256(string_agg(case when b.p = a.p then a.f else b.h end, '' order by b.p)) end as f
  from {before} a left join {tree}{k} c on c.t = a.t and c.p = a.p // 8 left join {tree}{k - 1} b on c.t is not null and b.t = a.t and b.p // 8 = a.p // 8
  group by a.r, a.t, a.p)"""


_LOW, _TOP = range(1, 9), range(1, 5)  # levels under a subroot (16 million rows of a language) and above (4096 languages)
_MERKLE_SQL = f"""
with d as (
  select *, row_number() over () as r, sha256({_LEAF.format("text")}) as leaf, crc32 % 3 = 0 as hit,
         sha256({_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) as changed
  from (select *, xor({_CRC32}, 4294967295) as crc32 from documents)
), langs as (
  select lang, row_number() over (order by lang nulls first) - 1 as t from (select distinct lang from documents)
), placed as (
  select r, t, doc_id, leaf, coalesce(case when hit then changed end, leaf) as f, row_number() over (partition by t order by doc_id nulls first, leaf) - 1 as p
  from d join langs on d.lang is not distinct from langs.lang
), low0 as (select t, p, leaf as h from placed), {", ".join(_merkle_level("low", k) for k in _LOW)},
subroots as (select t, arg_max(h, k) as h from ({" union all ".join(f"select t, h, {k} as k from low{k} where (select count(*) from low{k} o where o.t = low{k}.t) = 1" for k in (0, *_LOW))}) group by t),
top0 as (select 0 as t, t as p, h from subroots), {", ".join(_merkle_level("top", k) for k in _TOP)},
root as (select arg_max(h, k) as h from ({" union all ".join(f"select h, {k} as k from top{k} where (select count(*) from top{k}) = 1" for k in (0, *_TOP))})),
a0 as (select r, t, p, '' as proof, f from placed), {", ".join(_merkle_fold("a", f"a{k - 1}", "low", k) for k in _LOW)},
b0 as (select r, 0 as t, t as p, proof, f from a{_LOW[-1]}), {", ".join(_merkle_fold("b", f"b{k - 1}", "top", k) for k in _TOP)}
select doc_id, leaf, s.h as subroot, root.h as root, sha256(b.proof) as proof_sha256, b.f as folded_root, b.f = root.h as verified
from placed join b{_TOP[-1]} b using (r) join subroots s on s.t = placed.t, root"""

_HARD_SQL = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, e.vec_id, e.label = a.label as same, list_dot_product(a.v, e.v)::bigint as score
  from e a, e where a.vec_id % 100 = 0 and e.vec_id <> a.vec_id
), p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score,
       row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::integer as rank
from p join s using (anchor_id) where not same and 100 * score between 30 * positive_score and 90 * positive_score
qualify rank <= 10"""

_REPEATS_SQL = r"""
with docs as (
  select doc_id, row_number() over () as r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), windows as (
  select r, doc_id, k, array_to_string(w[k : k + 12], ' ') as gram from (select r, doc_id, w, unnest(range(1, len(w) - 11)) as k from docs where len(w) >= 13)
), late as (
  select r, k from (select r, k, doc_id, min(doc_id) over (partition by gram) as first from windows) where doc_id > first
), gone as (
  select r, list(distinct spot) as gone, count(distinct spot) as n from (select r, unnest(range(k, k + 13)) as spot from late) group by r
)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed,
       sha256(coalesce(case when n is null then array_to_string(w, ' ') else array_to_string([w[i] for i in range(1, len(w) + 1) if not list_contains(gone, i)], ' ') end, '')) as kept_sha256
from docs left join gone using (r)"""

ORACLES: dict[str, str] = {
    "op4_warc_revisits": _WARC_SQL,
    "op8_chat_format": _CHAT_SQL,
    "op9_lm_scores": _LM_SQL,
    "op10_decontamination": _DECONTAM_SQL,
    "op11_merkle_manifest": _MERKLE_SQL,
    "op12_hard_negatives": _HARD_SQL,
    "op13_substring_dedup": _REPEATS_SQL,
}
