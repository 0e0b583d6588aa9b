"""Scores of rollouts: structure, accuracy, tool use, length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorewright.functions.extract import _c, reward_letter, tagged_number
from scorewright.functions.keys import tool_calls
from scorewright.functions.metrics import mra

Text = Column | str

# fixed values: step labels and fields of the rollout protocol
STEPS = ("1", "2", "2.1", "2.2", "3", "3.1", "3.2", "4", "5")
#: Names of the map tool and the view tool; pass others where a log has others.
TOOLS = ("spatial_map", "view_image")
MAP_FIELDS = ("categories", "scene_type", "knowledge_type", "output_format")
TURN_MARK = r"---\s*\[Turn\s*\d+:\s*Assistant\]\s*---"
EXTRA_STEP = r"(?m)(?:#{1,3}\s*)?(?:✅\s*)?[Ss]tep\s*([6-9]|\d{2,})(?:\.\d+)?(?:\s|:|$)"
GATE = 0.85
WEIGHTS = {"structure": 0.15, "accuracy": 0.60, "tool": 0.10, "length": 0.15}


def has_step(text: Text, label: str) -> Column:
    """Whether a step heading with this label occurs."""
    escaped = label.replace(".", r"\.")
    return _c(text).rlike(rf"(?m)(?:#{{1,3}}\s*)?(?:\*{{1,2}})?[Ss]tep\s*{escaped}(?:\*{{1,2}})?(?:[:\s]|$)")


def extra_steps(text: Text) -> Column:
    """Number of headings of steps beyond 5."""
    return F.regexp_count(_c(text), F.lit(EXTRA_STEP))


def fake_calls(text: Text, tools: tuple[str, str] = TOOLS) -> Column:
    """Tool-call JSON written outside the call tags."""
    bare = F.regexp_replace(_c(text), r"(?s)<tool_call>.*?</tool_call>", "")
    named = lambda tool: F.regexp_count(bare, F.lit(rf"""["']name["']\s*:\s*["']{tool}["']"""))
    return named(tools[0]) + named(tools[1])


def answered(text: Text) -> Column:
    return _c(text).rlike(r"(?is)<Answer>.*?</Answer>")


def looping(text: Text, least: int = 3000, times: int = 3) -> Column:
    """A long text without an answer in which characters 200 to 400 come back
    at least ``times`` times (counted without overlaps)."""
    t = _c(text)
    piece = F.substring(t, 201, 200)
    count = (F.length(t) - F.length(F.replace(t, piece, F.lit("")))) / F.length(piece)
    return (F.length(t) >= least) & ~answered(t) & (F.length(piece) >= 50) & (count >= times)


def _line(text: Column, label: str) -> Column:
    """First 80 characters after a step's heading, in lower case; null if none."""
    pattern = rf"(?:#{{1,3}}\s*)?[Ss]tep\s*{label}(?:\s|:)(.*)"
    return F.when(text.rlike(pattern), F.left(F.lower(F.regexp_extract(text, pattern, 1)), F.lit(80)))


def _arguments(call: Column) -> Column:
    return F.from_json(call["arguments"], "map<string,string>")


def _is_object(call: Column) -> Column:
    return F.trim(call["arguments"]).startswith("{")


def _complete(call: Column) -> Column:
    keys = F.map_keys(_arguments(call))
    return _is_object(call) & (F.size(F.array_except(F.array(*map(F.lit, MAP_FIELDS)), keys)) == 0)


def _has_categories(call: Column) -> Column:
    found = F.from_json(F.get_json_object(call["arguments"], "$.categories"), "array<string>")
    return F.coalesce(F.size(found) > 0, F.lit(False))


def structure_reward(text: Text, calls: Text | None = None, names: tuple[str, str] = TOOLS) -> Column:
    """Format score in [0, 1]: 0 without an answer, in a loop, or for steps
    claimed without a start or a tool; else 1 less deductions.

    ``calls`` may be a column with ``tool_calls`` of the text.
    """
    t = _c(text)
    calls = _c(calls) if calls is not None else tool_calls(t)
    uses = lambda tool: F.exists(calls, lambda c: c["name"] == tool)
    maps, views = uses(names[0]), uses(names[1])
    tools = maps | views
    step = {s: has_step(t, s) for s in STEPS}
    any_of = lambda labels: F.greatest(*(step[s] for s in labels))
    jumps = ~tools & ~step["1"] & any_of(STEPS[1:])
    later = F.slice(F.split(t, TURN_MARK), 3, 1 << 30)
    restarts = tools & F.exists(later, lambda part: has_step(part, "1"))
    said = {k: _line(t, k) for k in ("1", "4", "5")}
    has = lambda line, *words: F.greatest(F.lit(False), *(F.coalesce(line.contains(w), F.lit(True)) for w in words))
    deductions = [
        (~step["1"], 0.30),
        (~step["5"], 0.20),
        (~maps & step["2.2"], 0.35),
        (~views & step["3.2"], 0.35),
        (maps & ~any_of(("2", "2.1", "2.2")), 0.10),
        (views & ~any_of(("3", "3.1", "3.2")), 0.10),
        (tools & ~step["4"], 0.10),
        (restarts, 0.15),
        (~has(said["1"], "visual"), 0.10),
        (~has(said["5"], "final", "answer"), 0.10),
        (tools & ~has(said["4"], "cross", "valid", "verif"), 0.05),
    ]
    score = F.lit(1.0)
    for rule, cost in deductions:
        score = score - F.when(rule, cost).otherwise(0.0)
    of_call = lambda c: (
        F.when(c["parse_error"], 0.15)
        .when(c["name"] != names[0], 0.0)
        .when(~_is_object(c), 0.15)
        .otherwise(F.when(_complete(c), 0.0).otherwise(0.20) + F.when(_has_categories(c), 0.0).otherwise(0.05))
    )
    score = score - F.least(0.20 * extra_steps(t), F.lit(0.40))
    score = score - F.aggregate(calls, F.lit(0.0), lambda a, c: a + of_call(c))
    fakes = fake_calls(t, names)
    score = score - F.when(fakes >= 2, 0.30).when(fakes == 1, 0.15).otherwise(0.0)
    return F.when(~answered(t) | looping(t) | jumps, 0.0).otherwise(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def accuracy_reward(text: Text, solution: Text, answer_type: Text, structure: Text, gate: float = GATE) -> Column:
    """Letter match (``mca``) or mean relative accuracy (``na``), 0 below the
    gate of the structure score."""
    letter = F.coalesce((reward_letter(text) == F.upper(F.trim(_c(solution)))).cast("double"), F.lit(0.0))
    number = F.coalesce(mra(tagged_number(text), _c(solution).try_cast("double"), zero="exact"), F.lit(0.0))
    raw = F.when(_c(answer_type) == "na", number).otherwise(letter)
    return F.when(gated(structure, gate) > 0, 0.0).otherwise(raw)


def gated(structure: Text, gate: float = GATE) -> Column:
    """1 where the structure score is below the gate, so that accuracy is 0."""
    return (_c(structure) < gate).cast("double")


def tool_reward(calls: Text, accuracy: Text, names: tuple[str, str] = TOOLS) -> Column:
    """Half the accuracy for one or two complete map calls, a fifth for one to
    four views, less 0.15 for each map call beyond two; within [-1, 1]."""
    c = _c(calls)
    count = lambda test: F.size(F.filter(c, test))
    maps = count(lambda x: x["name"] == names[0])
    good = count(lambda x: (x["name"] == names[0]) & ~x["parse_error"] & _complete(x) & _has_categories(x))
    views = count(lambda x: x["name"] == names[1])
    score = F.when(good.between(1, 2), 0.5 * _c(accuracy)).otherwise(0.0) + F.when(views.between(1, 4), 0.2 * _c(accuracy)).otherwise(0.0)
    score = score - 0.15 * F.greatest(maps - 2, F.lit(0))
    return F.least(F.greatest(score, F.lit(-1.0)), F.lit(1.0))


def length_penalty(text: Text, mask: Text | None = None, budget: int = 2000, most: int = 4000, per_token: int = 8, ids: Text | None = None, by_turn: bool = False) -> Column:
    """0 up to the budget of model tokens, falling to -1 at ``most``.

    Tokens are the ones of ``mask``; where it is null, all of ``ids`` (the
    response's tokens, tool results included); where that is null too, the
    characters of the text without tool results and header, at ``per_token``
    characters each.  With ``by_turn`` both are arrays of one array per turn.
    """
    flat = (lambda c: F.flatten(_c(c))) if by_turn else _c
    fall = lambda n, b, m: F.when(n <= b, 0.0).when(n <= m, -(n - b) / float(m - b)).otherwise(-1.0)
    own = F.regexp_replace(_c(text), r"(?s)---\s*\[Tool Result\]\s*---.*?(?=---\s*\[Turn|$)", "")
    own = F.regexp_replace(own, r"(?m)^\[Rollout:.*?\]\n", "")
    chars = fall(F.length(own), budget * per_token, most * per_token)
    score = chars
    if ids is not None:
        score = F.when(_c(ids).isNotNull(), fall(F.size(flat(ids)), budget, most)).otherwise(score)
    if mask is not None:
        tokens = F.size(F.filter(flat(mask), lambda m: m == 1))
        score = F.when(_c(mask).isNotNull(), fall(tokens, budget, most)).otherwise(score)
    return score


def total_reward(structure: Text, accuracy: Text, tool: Text, length: Text, weights: dict[str, float] | None = None) -> Column:
    w = weights or WEIGHTS
    return _c(structure) * w["structure"] + _c(accuracy) * w["accuracy"] + _c(tool) * w["tool"] + _c(length) * w["length"]
