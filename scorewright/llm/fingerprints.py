"""Document fingerprints: bottom-k sketches of word shingles, in expressions only.

A sketch is the sorted array of the k smallest hashes of a text's distinct
shingles.  Sketches of parts merge into the sketch of the whole, and two
sketches estimate resemblance, containment and distinct shingle counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewright.llm.rows import named

WIDTH = 5
SIZE = 128
#: Rows between two neighbours of the id order that one task looks at, about.
BUCKET_ROWS = 1024
#: Most buckets of the id order: 15 steps of a search in a constant array.
BUCKET_BITS = 15


def word_hashes(text: Column) -> Column:
    """Hashes of the words: lower case, between white space; null has none."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def sketch_of(words: Column, width: int = WIDTH, size: int = SIZE) -> Column:
    """Bottom-k sketch of an array of word hashes.

    A text of fewer words than ``width`` is one shingle; without words the
    sketch is empty.  ``words`` should be a column, not an expression: it is
    looked at several times for each shingle.
    """
    n = F.size(words)
    at = F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)))
    shingles = F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(width))))
    hashes = F.when(n >= width, shingles).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)


def with_sketch(df: DataFrame, text: Column, name: str, width: int = WIDTH, size: int = SIZE) -> DataFrame:
    """``df`` with the sketch of ``text`` in column ``name``.

    Null and empty texts have an empty sketch; repeated rows keep theirs.  A
    column of that name is replaced.
    """
    words = "_words"
    while words in df.columns:
        words += "_"
    return df.withColumn(words, word_hashes(text)).withColumn(name, sketch_of(F.col(words), width, size)).drop(words)


def _low_of_union(a: Column, b: Column, size: int) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated Jaccard similarity of the shingle sets: the share of the
    union's sketch that both have.  Two empty sketches give 1."""
    low = _low_of_union(a, b, size)
    both = F.size(F.array_intersect(low, F.array_intersect(a, b)))
    return F.when(F.size(low) == 0, 1.0).otherwise(both / F.size(low))


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of a's shingles that b has; an empty a gives 1."""
    low = _low_of_union(a, b, size)
    own = F.array_intersect(low, a)
    both = F.size(F.array_intersect(own, b))
    return F.when(F.size(own) == 0, F.when(F.size(a) == 0, 1.0).otherwise(0.0)).otherwise(both / F.size(own))


def distinct_shingles(sketch: Column, size: int = SIZE) -> Column:
    """Estimated number of distinct shingles; exact below ``size``."""
    share = (F.element_at(sketch, size).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(sketch) < size, F.size(sketch).cast("double")).otherwise((size - 1) / share)


def merge_sketches(df: DataFrame, key: str, sketch: str, size: int = SIZE) -> DataFrame:
    """``key, sketch``: one sketch for all rows of a key, under the key's name.

    Each task keeps ``size`` hashes of a key before the shuffle (a ranked
    limit), so a key of any number of rows stays small.  Keys whose sketches
    are all empty or null get an empty one; a null key is a key.  Repeated rows
    change nothing, ties do not occur among distinct hashes, and an empty table
    gives an empty result.  Names may hold any characters, and other columns
    take no part.
    """
    rows = df.select(named(key).alias("k"), named(sketch).alias("s"))
    hashes = rows.select("k", F.explode("s").alias("h")).distinct()
    low = hashes.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("h"))).where(F.col("n") <= size)
    merged = low.groupBy(F.col("k").alias("m")).agg(F.sort_array(F.collect_list("h")).alias("low"))
    found = rows.select("k").distinct().join(merged, F.col("k").eqNullSafe(F.col("m")), "left")
    return found.select("k", F.coalesce("low", F.array().cast("array<bigint>"))).toDF(key, "sketch")


def _cuts(ids: DataFrame) -> list[int]:
    """Ids, present in the table, at which buckets start: the first id and
    approximate quantiles.  One id for about ``BUCKET_ROWS`` rows."""
    row = ids.agg(F.count("id").alias("n"), F.min("id").alias("low")).first()
    if not row["n"]:
        return []
    many = min((1 << BUCKET_BITS) - 2, row["n"] // BUCKET_ROWS)
    if not many:
        return [row["low"]]
    shares = [k / (many + 1) for k in range(1, many + 1)]
    found = ids.agg(F.percentile_approx("id", shares, max(10_000, 10 * many)).alias("q")).first()["q"]
    return sorted({row["low"], *found})


def _constant(values: list[int]) -> Column:
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)")


def _bucket(value: Column, cuts: list[int]) -> Column:
    """Number of cuts up to a value, by binary search in a constant array."""
    steps = [1 << k for k in reversed(range(max(1, len(cuts).bit_length())))]
    array = _constant(cuts)
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when(F.get(array, at + step - 1) <= value, at + step).otherwise(at),
    )


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` (with a long ``id``) and the ``columns`` of the next row by
    ascending id, as ``next_...``; the first row follows the last.

    The id order is cut into buckets at ids that the table has.  The rows of
    the id that starts a bucket are also sent to the bucket before, behind its
    own rows, so each bucket knows its successor and no task sees all rows.
    Rows of one id stand in the order of ``columns``.  Rows without an id form
    an order of their own; its last row has null for the next.
    """
    cuts = _cuts(docs.select("id"))
    if not cuts:
        own = Window.partitionBy("id").orderBy(*columns)
        return docs.withColumns({f"next_{c}": F.lead(c).over(own) for c in columns})
    bucket = F.when(F.col("id").isNull(), F.lit(0)).otherwise(_bucket(F.col("id"), cuts))
    placed = docs.withColumn("_bucket", bucket)
    starts = F.get(_constant(cuts), F.col("_bucket") - 1) == F.col("id")  # of the bucket that was searched for
    before = F.when(F.col("_bucket") > 1, F.col("_bucket") - 1).otherwise(F.lit(len(cuts)))
    own = F.struct(F.lit(0).alias("tail"), F.col("_bucket").alias("bucket"))
    copy = F.struct(F.lit(1).alias("tail"), before.alias("bucket"))
    places = F.when((F.col("_bucket") > 0) & starts, F.array(own, copy)).otherwise(F.array(own))
    rows = placed.withColumn("_place", F.explode(places))
    order = Window.partitionBy("_place.bucket").orderBy("_place.tail", "id", *columns)
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return rows.where(F.col("_place.tail") == 0).drop("_bucket", "_place")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, size: int = SIZE) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last floor(n / 4) code points replaced by the
    first as many (or all) of the next document.  Returns ``doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    n_shingles, edited_kept, n_together``: ``edited_kept`` is the share of the
    text's shingles that the edited text contains, ``n_together`` the distinct
    shingles of both, from their merged sketch.  Null texts are empty.  A text without words has an empty
    fingerprint, which is like another empty one only.
    """
    rows = docs.select(named(id_col).cast("long").alias("id"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_next(with_sketch(rows, F.col("text"), "sketch", width, size), ["text", "sketch"])
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    rows = rows.select("id", "sketch", "next_sketch", n.alias("n"), edited.alias("edited"))
    rows = with_sketch(rows, F.col("edited"), "edited_sketch", width, size)
    written = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    following = F.coalesce("next_sketch", F.array().cast("array<bigint>"))
    return rows.select(
        F.col("id").alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        written("sketch").alias("fingerprint"),
        written("edited_sketch").alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), size).alias("near_edited"),
        resemblance(F.col("sketch"), following, size).alias("near_next"),
        F.round(distinct_shingles(F.col("sketch"), size), 3).alias("n_shingles"),
        containment(F.col("sketch"), F.col("edited_sketch"), size).alias("edited_kept"),
        F.round(distinct_shingles(_low_of_union(F.col("sketch"), F.col("edited_sketch"), size), size), 3).alias("n_together"),
    )
