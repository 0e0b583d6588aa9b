"""Objects that captions mention, by a dictionary of names of one or more words."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: letters and digits of any script.
WORD = r"[\p{L}\p{N}]+"


def phrase_index(dictionary: DataFrame) -> DataFrame:
    """``first, forms``: the phrases that begin with a word, the longest first.

    ``dictionary`` has ``phrase`` (words joined by single spaces), ``word``
    (what it stands for) and ``object`` (null: the phrase is no object, but
    its words are used up).  Null or blank phrases are none; of rows with the
    same phrase the first by word and object counts.
    """
    parts = F.filter(F.split(F.lower("phrase"), r"\s+"), lambda w: w != "")
    rows = dictionary.select(parts.alias("parts"), F.struct(F.coalesce("word", "phrase").alias("word"), F.col("object").alias("object")).alias("means"))
    one = rows.where(F.size("parts") > 0).groupBy("parts").agg(F.min("means").alias("means"))
    form = F.struct((-F.size("parts")).alias("rank"), F.col("parts"), F.col("means.word").alias("word"), F.col("means.object").alias("object"))
    return one.groupBy(F.get("parts", F.lit(0)).alias("first")).agg(F.sort_array(F.collect_list(form)).alias("forms"))


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _taken(at: pd.Series, size: pd.Series) -> pd.Series:
    """Which matches stay, from the left, when one uses up its words."""

    def one(places, sizes) -> list[bool]:
        free, out = 0, []
        for a, n in zip(places, sizes, strict=True):
            out.append(bool(a >= free))
            free = a + n if a >= free else free
        return out

    return pd.Series([one(a, n) for a, n in zip(at, size, strict=True)])


def caption_objects(captions: DataFrame, key: str, text: str, dictionary: DataFrame, unless: Mapping[str, str] | None = None) -> DataFrame:
    """``key, words, objects`` of every caption: what it mentions, in order,
    repeats included.

    Names are found leftmost first and longest at a place, and no word counts
    twice.  ``words`` are what the phrases stand for, ``objects`` those that
    are objects.  ``unless`` drops a word wherever the caption also has the
    other one (a seat of a toilet is no chair).  Names are compared as they
    stand, in lower case; forms such as plurals are rows of the dictionary.

    Words meet the dictionary in a join on the first word of a phrase, which
    Spark broadcasts or shuffles by its size; only the next few words of a
    place travel, and only places that match are grouped.  ``key`` is unique.
    Null and blank captions mention nothing; an empty dictionary has nothing
    to find.
    """
    index = phrase_index(dictionary)
    longest = index.agg(F.max(-F.get("forms", F.lit(0))["rank"])).first()[0] or 1
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)
    # the words, and the words from the next one on, ... side by side: compiled, where a function of each word is not
    later = [F.slice("_w", F.lit(k + 1), F.greatest(F.size("_w") - k, F.lit(0))).alias(f"w{k}") for k in range(longest)]
    places = captions.select(F.col(key), words.alias("_w")).select(key, F.posexplode(F.arrays_zip(*later)).alias("_at", "_next"))
    ahead = F.array(*(F.col("_next")[k.name] for k in places.schema["_next"].dataType.fields))
    both = places.join(index, F.col("_next")[places.schema["_next"].dataType.fields[0].name] == F.col("first")).withColumn("_ahead", ahead)
    fits = F.filter("forms", lambda f: F.slice(F.col("_ahead"), 1, F.size(f["parts"])) == f["parts"])
    found = both.select(key, "_at", F.get(fits, F.lit(0)).alias("_f")).where("_f is not null")
    match = F.struct(F.col("_at").alias("at"), (-F.col("_f.rank")).alias("size"), F.col("_f.word").alias("word"), F.col("_f.object").alias("object"))
    listed = found.groupBy(key).agg(F.sort_array(F.collect_list(match)).alias("_m"))
    flags = _taken(F.transform("_m", lambda m: m["at"]), F.transform("_m", lambda m: m["size"]))
    listed = listed.withColumn("_keep", flags)
    kept: Column = F.filter("_m", lambda m, k: F.get("_keep", k))
    if unless:
        pairs = F.create_map(*(F.lit(v) for pair in unless.items() for v in pair))
        listed = listed.withColumn("_m", kept).withColumn("_has", F.array_distinct(F.transform("_m", lambda m: m["word"])))
        other = lambda m: F.try_element_at(pairs, m["word"])
        kept = F.filter("_m", lambda m: ~F.coalesce(F.array_contains("_has", other(m)), F.lit(False)))
    listed = listed.select(key, kept.alias("_m"))
    none = F.array().cast("array<string>")
    out = captions.select(key).join(listed, key, "left")
    mentioned = F.filter(F.transform("_m", lambda m: m["object"]), lambda o: o.isNotNull())
    return out.select(key, F.coalesce(F.transform("_m", lambda m: m["word"]), none).alias("words"), F.coalesce(mentioned, none).alias("objects"))
