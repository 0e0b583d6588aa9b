"""Extraction, metrics and rewards on hand-made cases."""

import difflib
import math

import pytest
from pyspark.sql import functions as F

from scorewright.functions import extract as E
from scorewright.functions import keys as K
from scorewright.functions import metrics as M
from scorewright.functions import registry
from scorewright.functions import trajectory as T
from scorewright.operators import aggregate as A


def one(spark, expr, **values):
    """Value of an expression over one row of literals."""
    row = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(lit, v)).alias(k) for k, v in values.items()))
    return row.select(expr.alias("v")).first()["v"]


def lit(v):
    return F.array(*map(lit, v)) if isinstance(v, list) else F.lit(v)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("so <Answer> B </Answer> A.", "B"), ("<answer>\nC\n</answer>", "C"), ("A. x B. y", "B"), ("my answer is D", "D"), ("x\nE\nno", "E"),
        ("nothing here", None), ('he said "C" then', "C"), (None, None),
    ],
)
def test_letter_cascade(spark, text, want):
    assert one(spark, E.letter_cascade(F.col("t").cast("string")), t=text) == want


def test_choices(spark):
    opts = ["red apple", "blue", "green"]
    pick = lambda fn, t, **k: one(spark, fn(F.col("t"), F.col("o"), **k), t=t, o=opts)
    assert pick(E.choice_letter, "I say (B) or (A)") == "A"
    assert pick(E.choice_letter, "it is B .") == "B"
    assert pick(E.choice_letter, "after some thought it must be the green one") == "C"
    assert pick(E.choice_letter, "no idea") is None
    assert pick(E.choice_letter, "no idea", key=F.lit(5)) in "ABC"
    assert pick(E.unique_option, "B, surely") == "B" and pick(E.unique_option, "A or B") is None and pick(E.unique_option, "a RED apple") == "A"
    assert pick(E.multi_choice, "I pick blue not green") == "(B)" and pick(E.multi_choice, "x: C") == "(C)" and pick(E.multi_choice, "x: Z") == "[invalid]"
    q = "Which?\nA. red apple\nB. Blue."
    assert one(spark, E.option_text(F.lit(q), F.lit(" blue. "))) == "B" and one(spark, E.option_text(F.lit(q), F.lit(" none. "))) == "none"


def test_lists_and_patterns(spark):
    assert one(spark, E.majority_vote(F.col("r")), r=["b", "a", "a", "b"]) == "b"
    assert one(spark, E.take_first(F.array().cast("array<string>"))) == ""
    with pytest.raises(Exception, match="fewer than 3"):
        one(spark, E.take_first_k(F.col("r"), 3), r=["a"])
    assert one(spark, E.regex_filter(F.lit("x (1)|(22)"), r"\((\d+)\)", -1)) == "22"
    assert one(spark, E.regex_filter(F.lit("ab"), r"(x)|(b)", groups=2)) == "b"
    assert one(spark, E.boxed(F.lit(r"\boxed{1} \boxed{a{b{c}}d}"))) == "a{b{c}}d"
    assert one(spark, E.tagged_number(F.lit("<ANSWER> about 1,250.5 m </ANSWER>"))) == 1250.5
    assert one(spark, E.vqa_form(F.lit("The  Two dogs, arent 1,000 a.b"))) == "2 dogs aren't 1000 ab"
    assert one(spark, E.judge_json(F.lit('x {"score": 3}'), "score int")["score"]) == 3
    assert one(spark, E.speech_form(F.lit("<|zh|>你好 吗"), characters=True)) == "你 好 吗"


@pytest.mark.parametrize(("pred", "gold", "kind", "want"), [(10, 10, "zero", 1.0), (8, 10, "zero", 0.7), (0, 0, "zero", 0.0), (0, 0, "exact", 1.0), (0.3, 0, "absolute", 0.5), (1, 0, "null", None), (-10, -10, "zero", 1.0)])
def test_mra(spark, pred, gold, kind, want):
    got = one(spark, M.mra(F.lit(float(pred)), F.lit(float(gold)), kind))
    if want is None:
        assert got is None
    else:
        share = sum(abs(pred - gold) / (abs(gold) or 1) <= 1 - t for t in M.MRA_STEPS) / 10
        assert got == pytest.approx(want if kind in ("zero", "exact") and gold == 0 else share)


def test_metrics(spark):
    assert one(spark, M.anls(F.lit("Hello  World"), F.array(F.lit("hello world"), F.lit("x")))) == 1.0
    assert one(spark, M.vqa_consensus(F.lit("a"), F.col("x")), x=["a", "a", "b"]) == pytest.approx((1 / 3 + 1 / 3 + 2 / 3) / 3)
    assert one(spark, M.token_edit(F.col("a"), F.col("b")), a=list("kitten"), b=list("sitting")) == 3
    assert one(spark, M.many_box_iou(F.col("a"), F.col("b")), a=[[0.0, 0.0, 1.0, 1.0]], b=[[0.0, 0.0, 1.0, 1.0], [5.0, 5.0, 6.0, 6.0]]) == 0.5
    assert one(spark, M.geo_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(math.pi * M.EARTH_KM)
    assert one(spark, M.damerau_similarity(F.lit("abcd"), F.lit("abdc"))) == 0.75
    assert one(spark, M.ratcliff_similarity(F.lit("night"), F.lit("nacht"))) == pytest.approx(difflib.SequenceMatcher(None, "night", "nacht").ratio())
    assert one(spark, M.lcs_f(F.col("a"), F.col("b")), a=list("abcd"), b=list("acd")) == pytest.approx((1 + 1.44) * 0.75 * 1 / (1 + 1.44 * 0.75))
    assert one(spark, M.map_equality(M.json_map(F.lit('{"a":"1"}')), M.json_map(F.lit('{"a":"1"}')))) == 1.0
    assert one(spark, M.map_jaccard(M.json_map(F.lit('{"a":"x y"}')), M.json_map(F.lit('{"a":"x z","b":"q"}')))) == pytest.approx((1 / 3 + 0) / 2)


def test_instructions(spark):
    text = "Sure, here:\nplain words only"
    check = lambda fn, name, arg="": one(spark, fn(F.lit(name), F.lit(text), F.lit(arg)))
    assert check(M.follows, "no_comma") is False and check(M.follows_loosely, "no_comma") is True
    assert check(M.follows, "min_words", "5") is True and check(M.follows, "json") is False and check(M.follows, "unknown") is None


CHECKED = [
    ("keywords", "Big Apple pie", "apple|PIE", True), ("keywords", "apple", "apple|pie", False), ("keyword_count", "a A b", "a|at least|2", True), ("keyword_count", "a A b", "a|less than|2", False),
    ("forbidden", "cattle", "cat|dog", True), ("forbidden", "a Cat.", "cat|dog", False), ("letter_count", "Eel", "e|at least|2", True), ("letter_count", "Eel", "e|less than|2", False),
    ("sentences", "One. Two! Three", "at least|3", True), ("sentences", "One. Two!", "at least|3", False), ("words", "one, two-three", "less than|4", True), ("words", "", "at least|1", False),
    ("paragraphs", "a\n***\nb", "2", True), ("paragraphs", "*** a *** *** b", "2", False), ("paragraphs", "***a***b***", "2", True),
    ("paragraph_start", "One x.\n\n'Two, y", "2|2|two", True), ("paragraph_start", "One\n\n\n\nTwo", "2|2|one", False), ("paragraph_start", "One", "1|3|one", False),
    ("placeholders", "[a] and [b c]", "2", True), ("placeholders", "[a", "1", False), ("postscript", "Bye.\nP. S. more", "", True), ("second_postscript", "P.P.S more", "", True), ("second_postscript", "P.S. more", "", False),
    ("bullet_lines", "* a\n- b\n** c", "2", True), ("bullet_lines", "a", "1", False), ("options", "My answer is yes.", "My answer is yes.|My answer is no.", True), ("options", "maybe", "yes|no", False),
    ("highlights", "*a* and **b c**", "2", True), ("highlights", "** **", "1", False), ("sections", "SECTION 1 a SECTION 2 b", "SECTION|2", True), ("sections", "SECTION 1", "SECTION|2", False),
    ("json", '```json\n{"a": 1}\n```', "", True), ("title", "<<Poem>>", "", True), ("title", "<< >>", "", False), ("two_responses", "a ****** b", "", True), ("two_responses", "a ****** a", "", False), ("two_responses", "a", "", False),
    ("repeats_prompt", "Say it. Then more", "say it", True), ("ends_phrase", 'so "The End"', "the end", True), ("ends_phrase", "no", "the end", False), ("capital_words", "ONE TWO three A1", "at least|3", True), ("capital_words", "One 12", "at least|1", False),
]


@pytest.mark.parametrize(("name", "text", "argument", "want"), CHECKED)
def test_more_instructions(spark, name, text, argument, want):
    assert one(spark, M.follows(F.lit(name), F.lit(text), F.lit(argument))) is want


def test_rouge_of_several_references(spark):
    refs = [list("xbd"), list("abcdxyzw"), None]
    p, r = max(2 / 4, 4 / 4), max(2 / 3, 4 / 8)
    assert one(spark, M.rouge_l(F.col("a"), F.col("b")), a=list("abcd"), b=refs) == pytest.approx((1 + 1.44) * p * r / (r + 1.44 * p))
    assert one(spark, M.rouge_l(F.col("a"), F.array(F.col("b"))), a=list("abcd"), b=list("acd")) == pytest.approx(one(spark, M.lcs_f(F.col("a"), F.col("b")), a=list("abcd"), b=list("acd")))
    assert one(spark, A.bleu_tokens(F.lit("It's a (Test).")).cast("string")) == "[It, ', s, a, (, Test, ), .]"


GOOD = """[Rollout: 2 turns, tools: ['spatial_map']]
--- [Turn 1: Assistant] ---
### Step 1: Visual clues
<tool_call>{"name": "spatial_map", "arguments": {"categories": ["a"], "scene_type": "x", "knowledge_type": "y", "output_format": "z"}}</tool_call>
--- [Tool Result] ---
some long result
--- [Turn 2: Assistant] ---
Step 2.2: read map
Step 4: Cross-validation
Step 5: Final answer
<Answer>B</Answer>"""


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (GOOD, 1.0), (GOOD.replace("<Answer>B</Answer>", ""), 0.0), (GOOD.replace("Step 4: Cross-validation\n", ""), 0.9), (GOOD.replace("Step 2.2: read", "Step 1: visual"), 0.75),
        (GOOD.replace('"scene_type": "x", ', ""), 0.8), (GOOD.replace('["a"]', "[]"), 0.95), (GOOD.replace('{"name": "spatial_map", "arg', '{"name" "arg'), 0.5), (GOOD + "\nStep 6 a\nStep 7 b\nStep 8 c", 0.6),
        ("Step 5: final\n<answer>A</answer>", 0.0), ("Step 1: visual\nStep 5: final\n<Answer>A</Answer>", 1.0), ("Step 1: look\nStep 2.2: x\nStep 5: done\n<Answer>A</Answer>", 0.45),
        ('Step 1: visual\nStep 5: final {"name": "view_image"}\n<Answer>A</Answer>', 0.85),
    ],
)
def test_structure_reward(spark, text, want):
    assert one(spark, T.structure_reward(F.col("t")), t=text) == pytest.approx(want)


def test_other_rewards(spark):
    assert one(spark, T.accuracy_reward(F.lit(GOOD), F.lit("b"), F.lit("mca"), F.lit(0.9))) == 1.0
    assert one(spark, T.accuracy_reward(F.lit(GOOD), F.lit("b"), F.lit("mca"), F.lit(0.84))) == 0.0
    assert one(spark, T.accuracy_reward(F.lit("<Answer>9</Answer>"), F.lit("10"), F.lit("na"), F.lit(1.0))) == pytest.approx(0.9)
    calls = K.tool_calls(F.lit(GOOD))
    assert one(spark, T.tool_reward(calls, F.lit(0.8))) == pytest.approx(0.4)
    assert one(spark, T.tool_reward(K.tool_calls(F.lit(GOOD * 4)), F.lit(1.0))) == pytest.approx(-0.3)
    assert one(spark, T.length_penalty(F.lit("x"), F.array(*[F.lit(1)] * 5, F.lit(0)), 2, 8)) == pytest.approx(-0.5)
    assert one(spark, T.length_penalty(F.lit("x" * 24), None, 2, 4)) == pytest.approx(-0.5)
    loop = "a" * 200 + ("repeat this piece of text again and again to fill it. " * 100)
    assert one(spark, T.looping(F.lit(loop))) is True and one(spark, T.looping(F.lit(loop + "<Answer>x</Answer>"))) is False
    names = [(c["name"], c["parse_error"]) for c in one(spark, K.tool_calls(F.lit("<tool_call>{bad</tool_call><tool_call>{\"x\": 1}</tool_call><tool_call> {\"name\": \"v\"} </tool_call>")))]
    assert names == [("malformed", True), ("v", False)]


def test_registry(spark):
    with pytest.raises(ValueError, match="taken"):
        registry.register_metric("anls", M.anls)
    assert registry.METRICS["edit_distance"].higher_is_better is False
    df = spark.createDataFrame([("a", "a"), ("a", "b")], "p string, g string")
    fn = registry.process_results(lambda r: {"hit": float(r["p"] == r["g"])}, "hit double")
    assert [r["m"]["hit"] for r in df.select(fn(F.struct("p", "g")).alias("m")).collect()] == [1.0, 0.0]
