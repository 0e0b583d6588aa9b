"""Named metrics, aggregates and filters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from scorewright.functions import extract, metrics


@dataclass(frozen=True)
class Metric:
    """A per-sample metric with its direction and default aggregate."""

    name: str
    build: Callable[..., Column]
    higher_is_better: bool = True
    output_type: str = "generate_until"
    aggregate: str = "mean"


METRICS: dict[str, Metric] = {}
FILTERS: dict[str, Callable[..., Column]] = {}

#: Default metrics of each kind of output.
DEFAULTS = {
    "loglikelihood": ["perplexity", "acc"],
    "multiple_choice": ["acc", "acc_norm"],
    "generate_until": ["exact_match"],
}


def register_metric(name: str, build: Callable[..., Column], **about) -> Metric:
    """Add a metric; a taken name is an error."""
    if name in METRICS:
        raise ValueError(f"metric {name} is taken")
    METRICS[name] = Metric(name, build, **about)
    return METRICS[name]


def register_filter(name: str, build: Callable[..., Column]) -> None:
    """Add a filter, any function from Column to Column."""
    if name in FILTERS:
        raise ValueError(f"filter {name} is taken")
    FILTERS[name] = build


def process_results(fn: Callable[[dict], dict], schema: str) -> Callable[[Column], Column]:
    """A custom function from a row (struct column) to metrics, run in Arrow
    batches; its result has the given struct schema."""

    @F.pandas_udf(f"struct<{schema}>")
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([fn(r) for r in rows.to_dict("records")])

    return run


for _name, _build, _about in (
    ("exact_match", metrics.option_match, {}),
    ("anls", metrics.anls, {}),
    ("relaxed", metrics.relaxed, {}),
    ("mra", metrics.mra, {}),
    ("vqa_consensus", metrics.vqa_consensus, {}),
    ("token_f1", metrics.token_f1, {}),
    ("edit_distance", metrics.edit_distance, {"higher_is_better": False}),
):
    register_metric(_name, _build, **_about)

for _name, _build in (
    ("take_first", extract.take_first),
    ("take_first_k", extract.take_first_k),
    ("majority_vote", extract.majority_vote),
    ("remove_whitespace", extract.strip_leading_space),
    ("lowercase", extract.lowercase),
    ("uppercase", extract.uppercase),
    ("map", extract.mapped),
    ("regex", extract.regex_filter),
    ("multi_choice_regex", extract.multi_choice),
):
    register_filter(_name, _build)
