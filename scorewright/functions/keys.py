"""Cache keys, content hashes and requests: Columns to Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorewright.functions.extract import _c

Text = Column | str

# fixed values: generation settings that change a response
RELEVANT = (
    "temperature", "top_p", "top_k", "max_new_tokens", "max_gen_toks", "do_sample",
    "num_beams", "until", "repetition_penalty", "n", "best_of", "seed",
)


def canonical_kwargs(kwargs: Text) -> Column:
    """Sorted JSON text of the relevant settings; 0.0 and 0 are written alike."""
    kept = F.map_filter(_c(kwargs), lambda k, v: k.isin(*RELEVANT) & v.isNotNull())
    plain = F.transform_values(kept, lambda k, v: F.regexp_replace(v, r"^(-?\d+)\.0+$", "$1"))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(plain))))


def deterministic(kind: Text, kwargs: Text) -> Column:
    """Whether a request gives the same response each time."""
    value = lambda k: F.try_element_at(_c(kwargs), F.lit(k))
    number = lambda k, default: F.coalesce(value(k).try_cast("double"), F.lit(default))
    free = (number("temperature", 0.0) > 0) | (F.lower(F.coalesce(value("do_sample"), F.lit("false"))) == "true")
    return (_c(kind) == "loglikelihood") | ~(free | (number("n", 1.0) > 1) | (number("best_of", 1.0) > 1))


def content_hash(*parts: Text) -> Column:
    """16 hex digits of the SHA-256 of the parts joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\x00", *(F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts)), 256), 1, 16)


def cache_key(kind: Text, task: Text, doc_id: Text, idx: Text, kwargs: Text, content: Text) -> Column:
    """SHA-256 of the canonical request."""
    parts = F.struct(
        _c(kind).alias("kind"), _c(task).alias("task"), _c(doc_id).alias("doc_id"), _c(idx).alias("idx"),
        canonical_kwargs(kwargs).alias("kwargs"), _c(content).alias("content"),
    )
    return F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256)


def doc_hash(row: Text) -> Column:
    """SHA-256 of a struct as JSON."""
    return F.sha2(F.to_json(_c(row)), 256)


def call_key(media: Text, tool: Text, arguments: Text) -> Column:
    """Key of a tool call for dropping repeats; arguments is a map."""
    ordered = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(_c(arguments)))))
    return F.md5(F.concat_ws("|", _c(media), _c(tool), ordered))


def prefix_hash(prompt: Text, n: int = 256) -> Column:
    """Hash of the first ``n`` characters, to bring like prompts together."""
    return F.sha2(F.left(_c(prompt), F.lit(n)), 256)


def valid_response(kind: Text, text: Text, loglikelihood: Text) -> Column:
    """Neither null nor blank; a likelihood needs both its parts."""
    parts = _c(loglikelihood)
    return F.coalesce(
        F.when(_c(kind) == "loglikelihood", (F.size(parts) == 2) & parts[0].isNotNull() & parts[1].isNotNull()).otherwise(F.trim(_c(text)) != ""),
        F.lit(False),
    )


def tool_calls(text: Text) -> Column:
    """Calls in ``<tool_call>`` tags as array<struct<name, arguments,
    parse_error>>; blocks that are not JSON are ``malformed``, JSON without a
    name is left out."""
    blocks = F.regexp_extract_all(_c(text), F.lit(r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"), 1)

    def call(block: Column) -> Column:
        parsed = F.try_parse_json(block)
        name = F.get_json_object(block, "$.name")
        arguments = F.get_json_object(block, "$.arguments")
        return F.struct(
            F.when(parsed.isNull(), "malformed").otherwise(name).alias("name"),
            F.when(parsed.isNull(), "{}").otherwise(F.coalesce(arguments, F.lit("{}"))).alias("arguments"),
            parsed.isNull().alias("parse_error"),
        )

    return F.filter(F.transform(blocks, call), lambda c: c["name"].isNotNull())
