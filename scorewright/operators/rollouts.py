"""Rollouts as tables: merged turns and adaptive reward weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from scorewright.functions.extract import _c
from scorewright.functions.keys import tool_calls
from scorewright.operators.ordered import WIDTH, rolling


def merge_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One text per conversation: ``id, n_turns, text``.

    Assistant turns are numbered and marked, tool turns marked; turns of other
    roles and empty ones are left out; conversations without any are too.
    """
    rows = turns.where(F.col(role_col).isin("assistant", "tool") & (F.coalesce(F.col(text_col), F.lit("")) != ""))
    order = Window.partitionBy(id_col).orderBy(turn_col, role_col, text_col).rowsBetween(Window.unboundedPreceding, 0)
    number = F.sum((F.col(role_col) == "assistant").cast("int")).over(order)
    mark = F.when(F.col(role_col) == "assistant", F.concat(F.lit("[Turn "), number.cast("string"), F.lit(": Assistant]"))).otherwise("[Tool Result]")
    part = F.concat(F.lit("\n--- "), mark, F.lit(" ---\n"), F.col(text_col))
    names = F.when(F.col(role_col) == "assistant", F.transform(tool_calls(text_col), lambda c: c["name"]))
    rows = rows.select(id_col, F.struct(turn_col, role_col, part.alias("part"), names.alias("names")).alias("t"), number.alias("n"))
    merged = rows.groupBy(id_col).agg(F.sort_array(F.collect_list("t")).alias("ts"), F.max("n").alias("n_turns"))
    tools = F.flatten(F.filter(F.transform("ts", lambda t: t["names"]), lambda x: x.isNotNull()))
    listed = F.when(F.size(tools) == 0, "").otherwise(F.concat(F.lit("'"), F.array_join(tools, "', '"), F.lit("'")))
    head = F.concat(F.lit("[Rollout: "), F.col("n_turns").cast("string"), F.lit(" turns, tools: ["), listed, F.lit("]]"))
    body = F.array_join(F.transform("ts", lambda t: t["part"]), "\n")
    return merged.select(id_col, "n_turns", F.concat(head, body).alias("text"))


def turns_after_first_answer(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role") -> DataFrame:
    """``turns`` with ``assistant_turn`` (how many so far) and ``answered``
    (whether an assistant turn has come)."""
    order = Window.partitionBy(id_col).orderBy(turn_col).rowsBetween(Window.unboundedPreceding, 0)
    number = F.sum((F.col(role_col) == "assistant").cast("int")).over(order)
    return turns.withColumns({"assistant_turn": number, "answered": number > 0})


def saturated(mean: str, std: str, reference: Column) -> Column:
    """Near-zero deviation at the reference mean."""
    return ((_c(std) < 0.02) & (F.abs(_c(mean) - reference) < 0.05)).cast("double")


def rolling_stats(steps: DataFrame, window: int = 50, key: str = "reward", width: int = WIDTH) -> DataFrame:
    """``reward_steps`` (key, step, mean, std) with figures of the last
    ``window`` steps: mean, deviation, saturated share, slope (0 under five).
    Steps of a key are dealt to ranges of ``width`` (``rolling``), so a run of
    any length is many partitions."""
    flag = saturated("mean", "std", F.when(F.col(key) == "tool", 1.0).otherwise(0.0))

    def figures(last: WindowSpec) -> dict[str, Column]:
        n = F.count("mean").over(last)
        slope = F.coalesce(F.regr_slope("mean", F.col("pos").cast("double")).over(last), F.lit(0.0))
        return {
            "rolling_mean": F.avg("mean").over(last), "rolling_std": F.avg("std").over(last), "saturation": F.avg("flag").over(last),
            "slope": F.when(n >= 5, slope).otherwise(0.0), "n": n,
        }

    rows = rolling(steps.select(key, "step", "mean", "std", flag.alias("flag")), [key], ["step"], window, figures, width)
    return rows.select(key, "step", "mean", "std", "rolling_mean", "rolling_std", "saturation", "slope", "n")


def adaptive_weights(steps: DataFrame, base: dict[str, float], targets: dict[str, float], window: int = 50, key: str = "reward") -> DataFrame:
    """Weight of each adaptive reward (the keys of ``targets``) at each step."""
    return weights_of(rolling_stats(steps.where(F.col(key).isin(*targets)), window, key), base, targets, key)


def weights_of(figures: DataFrame, base: dict[str, float], targets: dict[str, float], key: str = "reward") -> DataFrame:
    """Weights of the adaptive rewards from their rolling figures, made of a
    table or by the stream.

    Base weight times headroom (deviation over its target, within 0.1 and 2),
    saturation discount and boost of falling trends; then scaled so that the
    adaptive weights of a step keep their base sum.  Fewer than five steps
    keep the base weight.
    """
    pick = lambda table: F.create_map(*(F.lit(v) for pair in table.items() for v in pair))[F.col(key)]
    rows = figures.where(F.col(key).isin(*targets))
    headroom = F.greatest(F.lit(0.1), F.least(F.lit(2.0), F.col("std") / F.greatest(F.lit(1e-6), pick(targets))))
    discount = 1 - F.greatest(F.lit(0.0), F.col("saturation") - 0.3) / 0.7
    boost = 1 + F.greatest(F.lit(0.0), F.least(F.lit(1.0), -F.col("slope") / (F.abs("mean") + 0.05)))
    raw = F.when(F.col("n") < 5, pick(base)).otherwise(pick(base) * headroom * discount * boost)
    rows = rows.withColumns({"base_weight": pick(base), "raw_weight": raw})
    step = Window.partitionBy("step")
    total = F.sum("raw_weight").over(step)
    weight = F.when(total > 0, F.col("raw_weight") * F.sum("base_weight").over(step) / total)
    return rows.select(key, "step", "base_weight", "raw_weight", weight.alias("weight"))
