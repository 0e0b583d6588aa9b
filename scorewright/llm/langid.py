"""Language identification by Bayesian evidence fusion.

The posterior of a row's language multiplies four sources of evidence:

* text: a multinomial model of hashed letter trigrams, tempered so that a long
  text is not taken for thousands of independent observations;
* declared language of the markup (or of the table);
* suffix of the address, through a small table of country suffixes;
* prior of the host, smoothed towards its domain, and that towards the whole
  table.  Host, domain and table counts are sums of text posteriors, made by
  grouped aggregation over all rows; a row's own share is left out of its
  host's count.

``und`` is a hypothesis of its own: trigrams drawn evenly.  Rows without
letters have no text evidence and are ``und``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewright.llm.rows import named, with_arrow_columns
from scorewright.sources.staging import staged

BUCKETS = 1 << 16
UNKNOWN = "und"
#: Bound of the labelled sample of each language that the text model is fitted on.
PER_LANGUAGE = 400
#: Trigrams that a text of any length counts as at most.
TEMPER = 60.0
#: Share of even trigrams in each language: a text with words that the sample
#: lacks is not taken for no language because of them.
EVEN = 0.2
#: Weight, in rows, of the domain in a host's prior and of the table in a domain's.
SMOOTH = 20.0
DECLARED_RIGHT = 0.9
SUFFIX_RIGHT = 0.7

# fixed values: languages of country suffixes
SUFFIXES = {
    "de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es", "co.uk": "en", "uk": "en",
    "us": "en", "au": "en", "ie": "en", "nz": "en", "it": "it", "nl": "nl", "pt": "pt", "br": "pt", "pl": "pl",
    "se": "sv", "dk": "da", "no": "no", "fi": "fi", "cz": "cs", "ru": "ru", "jp": "ja", "kr": "ko", "cn": "zh",
}
_OTHER = re.compile(r"[\W\d_]+")


def trigram_buckets(text: str | None) -> np.ndarray:
    """Buckets of the letter trigrams; runs of other characters are one space."""
    letters = _OTHER.sub(" ", text or "").strip().lower()
    if not letters:
        return np.empty(0, np.int64)
    c = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    h = c[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ c[2:] * np.uint64(0x165667B19E3779F9)
    return (h >> np.uint64(48)).astype(np.int64)


@dataclass
class TextModel:
    """Log probabilities of the buckets under each language."""

    languages: list[str]
    table: np.ndarray  # BUCKETS x languages

    def evidence(self, text: str | None) -> tuple[int, list[float]]:
        """Trigrams, and tempered log likelihoods of the languages and und."""
        at = trigram_buckets(text)
        n = len(at)
        if not n:
            return 0, [0.0] * (len(self.languages) + 1)
        counts = np.bincount(at, minlength=BUCKETS)  # one row of the table for each bucket, however long the text
        some = np.flatnonzero(counts)
        sums = np.append(counts[some] @ self.table[some].astype(np.float64), -n * math.log(BUCKETS))
        return n, (sums * (TEMPER / (TEMPER + n))).tolist()


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE) -> DataFrame:
    """At most ``per_language`` rows of each language, those with the lowest
    hashes of id and text; ``lang, text``.  Rows without a label or a text are
    not drawn.  Every label is a language, however rare."""
    rows = docs.select(
        F.lower(F.trim(named(lang_col).cast("string"))).alias("lang"), named(text_col).cast("string").alias("text"), F.xxhash64(named(id_col), named(text_col)).alias("h")
    ).where("lang is not null and lang <> '' and text is not null")
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return rows.select("lang", "text").limit(0)
    span = 1 << 30
    rate = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(span, span * 2 * per_language // r["count"] + 1))))
    few = rows.where(F.pmod("h", F.lit(span)) < F.coalesce(rate[F.col("lang")], F.lit(0)))
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text")))
    return ranked.where(F.col("rank") <= per_language).select("lang", "text")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> TextModel:
    """Fit the text model on a bounded sample of the labelled rows.

    Only (language, bucket) counts reach the driver: at most ``BUCKETS`` rows,
    256 KB of the model's table, for each language label (labels are codes; no
    label is left out).  Without labelled rows the model knows no language and
    everything is und.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                total = np.zeros(BUCKETS, np.int64)
                for t in texts:
                    total += np.bincount(trigram_buckets(t), minlength=BUCKETS)
                at = np.flatnonzero(total)
                yield pd.DataFrame({"lang": lang, "bucket": at, "n": total[at]})

    sample = labelled_sample(docs, id_col, text_col, lang_col, per_language)
    counts = sample.mapInPandas(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    table = np.full((BUCKETS, len(languages)), 0.2)
    for k, lang in enumerate(languages):
        part = counts[counts["lang"] == lang]
        table[part["bucket"].to_numpy(), k] += part["n"].to_numpy()
    if languages:
        table = np.log((1 - EVEN) * table / table.sum(axis=0) + EVEN / BUCKETS)
    return TextModel(languages, table.astype(np.float32))


def host_of(address: Column) -> Column:
    """Host of an address in lower case; a string without a scheme is its own host."""
    low = F.lower(F.trim(address))
    host = F.regexp_extract(low, r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(F.when(host != "", host).when(~low.contains("://"), low), F.lit(""))


def _softmax(scores: np.ndarray) -> np.ndarray:
    weights = np.exp(scores - scores.max(axis=1, keepdims=True))
    return weights / weights.sum(axis=1, keepdims=True)


def fuse(names: list[str], text: np.ndarray, own: np.ndarray, host: np.ndarray, domain: np.ndarray, told: list[tuple]) -> np.ndarray:
    """Posterior of each row over ``names``.

    ``text`` has log likelihoods, ``own`` the row's share of its host's
    counts ``host``, ``domain`` the prior of the host's domain; ``told`` has
    pairs of (language or None for each row, probability that it is right).
    """
    others = np.maximum(host - own, 0.0)
    prior = (others + SMOOTH * domain) / (others.sum(axis=1, keepdims=True) + SMOOTH)
    scores = np.log(prior) + text
    for values, right in told:
        wrong = math.log((1 - right) / max(1, len(names) - 1))
        for row, value in enumerate(values):
            if value in names and value != UNKNOWN:
                scores[row] += wrong
                scores[row, names.index(value)] += math.log(right) - wrong
    return _softmax(scores)


def identify(
    docs: DataFrame,
    model: TextModel,
    text_col: str = "text",
    declared: Column | None = None,
    address: Column | None = None,
    keep: list[str] | None = None,
) -> tuple[DataFrame, list[Column]]:
    """Every row with ``lang, confidence, text_lang, host, n_trigrams``.

    The second result selects the columns of ``docs`` (those in ``keep``)
    back.  A missing declared language, address or host is no evidence; rows
    without a host share the host ``''``.  Rows without letters are ``und``
    with confidence 1.  Repeated rows are judged alike; an empty table gives
    an empty result.
    """
    names = [*model.languages, UNKNOWN]
    many = len(names)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        def make(texts: list) -> list[pa.Array]:
            found = [shared.value.evidence(t) for t in texts]
            n = np.array([n for n, _ in found])
            post = _softmax(np.array([x for _, x in found])) * (n > 0)[:, None] if found else np.empty((0, many))
            doubles = pa.list_(pa.float64())
            return [pa.array(n, pa.int64()), pa.array([x for _, x in found], doubles), pa.array(list(post), doubles)]

        return make

    said = F.lower(F.regexp_extract(declared.cast("string"), r"^\s*([A-Za-z]+)", 1)) if declared is not None else F.lit("")
    host = host_of(address.cast("string")) if address is not None else F.lit("")
    shown = [c for c in docs.columns if keep is None or c in keep]
    rows = docs.select(
        *(named(c).alias(f"d{k}") for k, c in enumerate(shown)),
        F.coalesce(said, F.lit("")).alias("said"),
        host.alias("host"),
        named(text_col).cast("string").alias("_text"),
    )
    kept = [f"d{k}" for k in range(len(shown))]
    made, back = with_arrow_columns(rows, [F.col("_text")], start, "n_trigrams long, ll array<double>, post array<double>", [*kept, "said", "host"])
    scored = staged(made.select(*back, "n_trigrams", "ll", "post"), "evidence")
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    scored = scored.withColumn("domain", domain)
    sums = [F.sum(F.col("post")[k]).alias(f"h{k}") for k in range(many)]
    hosts = staged(scored.groupBy("host", "domain").agg(*sums), "hosts")
    domains = hosts.groupBy("domain").agg(*(F.sum(f"h{k}").alias(f"m{k}") for k in range(many)))
    whole = hosts.agg(*(F.coalesce(F.sum(f"h{k}"), F.lit(0.0)).alias(f"g{k}") for k in range(many))).first()
    base = [(x + 1.0) / (sum(whole) + many) for x in whole]
    weight = sum((F.col(f"m{k}") for k in range(1, many)), F.col("m0"))
    smoothed = [(F.col(f"m{k}") + SMOOTH * base[k]) / (weight + SMOOTH) for k in range(many)]
    counts = F.array(*(F.col(f"h{k}") for k in range(many)))
    priors = hosts.join(domains.select("domain", F.array(*smoothed).alias("prior")), "domain")
    priors = staged(priors.select("host", counts.alias("seen"), "prior"), "priors")
    suffix = F.regexp_extract("host", r"\.(co\.uk|[a-z]{2})$", 1)
    told = F.create_map(*(F.lit(x) for pair in SUFFIXES.items() for x in pair))[suffix]
    rows = scored.join(priors, "host")

    def judge():
        def make(n: list, ll: list, own: list, seen: list, prior: list, said: list, told: list) -> list[pa.Array]:
            if not n:
                return [pa.array([], t) for t in (pa.string(), pa.float64(), pa.string())]
            own = np.array(own)
            post = fuse(names, np.array(ll), own, np.array(seen), np.array(prior), [(said, DECLARED_RIGHT), (told, SUFFIX_RIGHT)])
            post[np.array(n) == 0] = own[np.array(n) == 0] = np.eye(many)[-1]
            best = post.argmax(axis=1)
            return [
                pa.array([names[k] for k in best], pa.string()),
                pa.array(post[np.arange(len(best)), best], pa.float64()),
                pa.array([names[k] for k in own.argmax(axis=1)], pa.string()),
            ]

        return make

    inputs = [F.col(c) for c in ("n_trigrams", "ll", "post", "seen", "prior", "said")]
    made, back = with_arrow_columns(
        rows, [*inputs, told], judge, "lang string, confidence double, text_lang string", [*kept, "host", "n_trigrams"]
    )
    out = made.select(*back, "lang", "confidence", "text_lang")
    return out, [F.col(f"d{k}").alias(c) for k, c in enumerate(shown)]


def keep_identified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose language is known, with their own columns.

    The model is fitted on a bounded sample of the same rows; ``lang`` is the
    declared language and ``source`` the host.  Null and empty texts have no
    known language and go; repeated rows are judged alike; ties go to the
    first language by name; an empty table gives an empty result.
    """
    model = fit(docs, id_col, text_col, lang_col)
    found, back = identify(docs, model, text_col, named(lang_col), named(source_col))
    return found.where(F.col("lang") != UNKNOWN).select(*back)


def markup_language(html: Column) -> Column:
    """The lang attribute of the html element; empty if there is none."""
    return F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1)


def markup_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments, tags and entities removed.
    Null stays null, an empty page is an empty text."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"&#?\w+;", " ")
