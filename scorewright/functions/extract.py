"""Answers out of responses: filters, extraction cascades and normalisers.

All functions map Columns to Columns and stay inside Spark's expressions.
Null responses give null unless a function names a fallback.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INVALID = "[invalid]"
Text = Column | str


def _c(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nullif_empty(x: Column) -> Column:
    return F.when(x != "", x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value evaluated once for each row, also where
    the body looks at it inside a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def first_match(x: Text, pattern: str, group: int = 1) -> Column:
    """Group of the first match; null if there is none or it is empty."""
    return nullif_empty(F.regexp_extract(_c(x), pattern, group))


def last_match(x: Text, pattern: str, group: int = 1) -> Column:
    """Group of the last match; null if there is none."""
    return F.get(F.reverse(F.regexp_extract_all(_c(x), F.lit(pattern), group)), 0)


# --- response lists (EXT1-EXT6) ---------------------------------------------


def take_first(resps: Text) -> Column:
    """First response; the empty string for an empty list."""
    return F.coalesce(F.get(_c(resps), 0), F.lit(""))


def take_first_k(resps: Text, k: int) -> Column:
    """First ``k`` responses; an error for a shorter list."""
    few = F.raise_error(F.lit(f"fewer than {k} responses"))
    return F.when(F.size(_c(resps)) >= k, F.slice(_c(resps), 1, k)).otherwise(few)


def majority_vote(resps: Text) -> Column:
    """Most frequent response; the first seen of equally frequent ones."""
    r = _c(resps)
    votes = F.transform(
        F.array_distinct(r),
        lambda v: F.struct(
            F.size(F.filter(r, lambda x: x == v)).alias("n"), (-F.array_position(r, v)).alias("first"), v.alias("value")
        ),
    )
    return F.array_max(votes)["value"]


def strip_leading_space(x: Text) -> Column:
    return F.regexp_replace(_c(x), "^ ", "")


def lowercase(x: Text) -> Column:
    return F.lower(_c(x))


def uppercase(x: Text) -> Column:
    return F.upper(_c(x))


def mapped(x: Text, mapping: dict[str, str], default: str | None = None) -> Column:
    """Value of a fixed mapping, or the default."""
    pairs = F.create_map(*(F.lit(v) for pair in mapping.items() for v in pair))
    return F.coalesce(F.try_element_at(pairs, _c(x)), F.lit(default).cast("string"))


# --- regular expressions (EXT7-EXT10) ---------------------------------------


def regex_filter(x: Text, pattern: str, group_select: int = 0, fallback: str = INVALID, groups: int = 1) -> Column:
    """The ``group_select``-th match (negative from the end), trimmed.

    ``groups`` is the number of capturing groups: with several, the first
    that is not empty counts; with none, the whole match.
    """
    lists = [F.regexp_extract_all(_c(x), F.lit(pattern), k) for k in (range(1, groups + 1) if groups else [0])]
    at = (lambda m: F.get(m, group_select)) if group_select >= 0 else (lambda m: F.get(F.reverse(m), -group_select - 1))
    picked = F.coalesce(*(nullif_empty(at(m)) for m in lists), at(lists[0]))
    return F.coalesce(F.trim(picked), F.lit(fallback))


def _plain(x: Column, ignore_case: bool, ignore_punctuation: bool, drop: list[str]) -> Column:
    for pattern in drop:
        x = F.regexp_replace(x, pattern, "")
    x = F.lower(x) if ignore_case else x
    return F.regexp_replace(x, r"\p{P}", "") if ignore_punctuation else x


def _earliest(response: Column, texts: Column) -> Column:
    """Position (from 0) in ``texts`` of the text that occurs first in the
    response, the longest one of those that start there; null if none."""
    found = F.transform(
        texts,
        lambda t, k: F.when(
            (F.length(t) > 0) & response.contains(t), F.struct(F.instr(response, t).alias("at"), (-F.length(t)).alias("n"), k.alias("k"))
        ),
    )
    return F.array_min(F.filter(found, lambda s: s.isNotNull()))["k"]


def multi_choice(
    x: Text,
    choices: Text,
    pattern: str = r"\(([A-Z])\)",
    fallback: str = INVALID,
    ignore_case: bool = False,
    ignore_punctuation: bool = False,
    drop: list[str] | None = None,
) -> Column:
    """Choice as ``(A)``: the pattern, else a choice's text in the response,
    else a letter after a colon."""
    opts = (ignore_case, ignore_punctuation, drop or [])
    texts = F.transform(_c(choices), lambda t: F.trim(_plain(t, *opts)))
    named = lambda letter: F.concat(F.lit("("), letter, F.lit(")"))
    letter = lambda k: F.chr(k + 65)
    after = first_match(x, r":\s*([A-Z])")
    known = F.when(F.ascii(after) - 65 < F.size(_c(choices)), after)
    return F.coalesce(
        named(first_match(x, pattern)),
        named(letter(_earliest(_plain(_c(x), *opts), texts))),
        named(known),
        F.lit(fallback),
    )


def option_text(question: Text, response: Text) -> Column:
    """Letter of the option whose text (lines ``A. text`` of the question) the
    response repeats, else the response without punctuation at its ends."""
    letters = F.regexp_extract_all(_c(question), F.lit(r"(?m)^\s*([A-Z])\.\s*(.+?)\s*$"), 1)
    texts = F.regexp_extract_all(_c(question), F.lit(r"(?m)^\s*([A-Z])\.\s*(.+?)\s*$"), 2)
    clean = lambda t: F.lower(F.regexp_replace(F.trim(t), r"^[\s\p{P}]+|[\s\p{P}]+$", ""))
    at = F.array_position(F.transform(texts, clean), clean(_c(response)))
    return F.coalesce(F.when(at > 0, F.get(letters, (at - 1).cast("int"))), F.regexp_replace(F.trim(_c(response)), r"^[\s\p{P}]+|[\s\p{P}]+$", ""))


def apply_pipeline(df: DataFrame, name: str, column: str, steps: list[Callable[[Column], Column]]) -> DataFrame:
    """``df`` with column ``name``: the steps applied one after the other."""
    value = F.col(column)
    for step in steps:
        value = step(value)
    return df.withColumn(name, value)


# --- answers in free text (EXT11-EXT22) --------------------------------------


def answer_tag(x: Text) -> Column:
    """Content of the first answer tag, written exactly so, else in any case."""
    exact = F.when(_c(x).rlike(r"(?s)<Answer>\s*.*?\s*</Answer>"), F.regexp_extract(_c(x), r"(?s)<Answer>\s*(.*?)\s*</Answer>", 1))
    loose = F.when(_c(x).rlike(r"(?is)<Answer>\s*.*?\s*</Answer>"), F.regexp_extract(_c(x), r"(?is)<Answer>\s*(.*?)\s*</Answer>", 1))
    return F.coalesce(exact, loose)


# fixed values: patterns in order of trust, the last match of each counts
LETTER_PATTERNS = (
    r"""(?:Answer: )?([A-E])\. [A-Za-z0-9 \-\(\)'",]+(?=(?:\n|$|\.|"))""",
    r"""(?:Answer: )?([A-E])\. [A-Za-z0-9 \-\(\)'"]+""",
    r"(?:^|\n)(?:Answer: )?([A-E])(?:\.|$|\s)",
    r"[\*\"]([A-E])[\*\"]",
    r"\bAnswer:?\s*([A-E])\b",
    r"[Mm]y answer is ([A-E])",
    r"[Mm]y answer is ([A-E])\.",
    r"answer is ([A-E])",
)


def letter_cascade(x: Text) -> Column:
    """Letter A to E: in the answer tag, the last ``X.``, the patterns in
    order, the last letter that stands alone on the lowest line with one."""
    in_tag = first_match(F.trim(answer_tag(x)), r"\b([A-E])\b")
    lines = F.reverse(F.split(_c(x), "\n"))
    alone = F.filter(F.transform(lines, lambda line: F.regexp_extract(line, r"\b([A-E])\b", 1)), lambda v: v != "")
    return F.coalesce(in_tag, last_match(x, r"([A-E])\."), *(last_match(x, p) for p in LETTER_PATTERNS), F.get(alone, 0))


def reward_letter(x: Text) -> Column:
    """Letter A to E for rewards: tag, ``X. ``, ``answer: X``; the first match."""
    return F.upper(
        F.coalesce(
            first_match(x, r"(?i)<Answer>\s*([A-E])\s*</Answer>"),
            first_match(x, r"\b([A-Ea-e])\.\s"),
            first_match(x, r"(?i)answer[:\s]+([A-E])\b"),
        )
    )


# fixed values: openings that carry no answer
PREFIXES = (
    "The best answer is", "The correct answer is", "The answer is", "The answer", "The best option is",
    "The correct option is", "Best answer:", "Best option:",
)


def prefixed_letter(x: Text, letters: str = "ABCD") -> Column:
    """First option letter after stock openings are removed; "" if a text of
    more than ten words has none."""
    text = F.trim(_c(x))
    for p in PREFIXES:
        text = F.replace(text, F.lit(p), F.lit(""))
    long = F.size(F.split(text, r"\s+")) > 10
    return F.when(long & ~text.rlike(f"[{letters}]"), "").otherwise(F.regexp_extract(text, f"[{letters}]", 0))


def choice_letter(x: Text, choices: Text, key: Text | None = None) -> Column:
    """Letter by ``(A)``, then ``A `` and ``A.``, then an option's text; of
    several the one that stands last.  Without any, a letter chosen by the
    hash of ``key``, or null if there is no key."""
    response = F.concat(F.lit(" "), F.regexp_replace(_c(x), r"^[,.!?;:']+|[,.!?;:']+$", ""), F.lit(" "))
    letters = F.transform(_c(choices), lambda t, k: F.chr(k + 65))

    def last(place: Callable[[Column, Column], Column]) -> Column:
        """``place`` gives the last position of an option, or 0."""
        found = F.transform(_c(choices), lambda t, k: F.struct(place(t, F.chr(k + 65)).alias("at"), F.chr(k + 65).alias("v")))
        return F.array_max(F.filter(found, lambda s: s["at"] > 0))["v"]

    def both(text: Column) -> Column:
        return let(text, lambda t: F.struct(t.alias("text"), F.reverse(t).alias("turned")))

    def back(needle: Column, hay: Column) -> Column:
        return F.when(hay["text"].contains(needle), F.length(hay["text"]) - F.instr(hay["turned"], F.reverse(needle)))

    def picked(hay: Column) -> Column:
        marked = last(lambda t, v: F.coalesce(back(F.concat(F.lit("("), v, F.lit(")")), hay), F.lit(0)))
        spaced = last(lambda t, v: F.coalesce(back(F.concat(F.lit(" "), v, F.lit(" ")), hay), F.lit(0)))
        dotted = last(lambda t, v: F.coalesce(back(F.concat(v, F.lit(".")), hay), F.lit(0)))
        low = both(F.lower(hay["text"]))
        worded = let(low, lambda h: last(lambda t, v: F.coalesce(F.when(F.length(t) > 0, back(F.lower(t), h)), F.lit(0))))
        many = F.size(F.split(F.trim(hay["text"]), r"\s+", 6)) > 5
        return F.coalesce(marked, spaced, dotted, F.when(many, worded))

    found = let(both(response), picked)
    if key is None:
        return found
    return F.coalesce(found, F.get(letters, F.pmod(F.xxhash64(_c(key)), F.size(_c(choices)).cast("long")).cast("int")))


def unique_option(x: Text, choices: Text) -> Column:
    """Letter that alone stands as a token (punctuation is a space), else the
    letter of the only option whose text occurs; null if none or several."""
    tokens = F.split(F.trim(F.regexp_replace(_c(x), r"[\.\(\),:;!\*#{}\[\]]", " ")), r"\s+")
    letters = F.transform(_c(choices), lambda t, k: F.chr(k + 65))
    only = lambda found: let(found, lambda f: F.when(F.size(f) == 1, F.get(f, 0)))
    named = let(tokens, lambda own: F.filter(letters, lambda v: F.array_contains(own, v)))

    def worded(low: Column) -> Column:
        held = F.transform(_c(choices), lambda t, k: F.when((F.length(t) > 0) & low.contains(F.lower(t)), F.chr(k + 65)))
        return F.filter(held, lambda v: v.isNotNull())

    return F.coalesce(only(named), only(let(F.lower(_c(x)), worded)))


def yes_no_label(x: Text) -> Column:
    """yes or no if the answer is one or starts with one, else other."""
    low = F.lower(F.trim(_c(x)))
    head = F.left(low, F.lit(4))
    return F.when(low.isin("yes", "no"), low).when(head.contains("yes"), "yes").when(head.contains("no"), "no").otherwise("other")


def first_yes_no(x: Text) -> Column:
    """1 if yes stands before no, 0 if no does, -1 without either."""
    low = F.lower(_c(x))
    yes, no = F.instr(low, F.lit("yes")), F.instr(low, F.lit("no"))
    return F.when((yes > 0) & ((no == 0) | (yes < no)), 1).when(no > 0, 0).otherwise(-1)


def boxed(x: Text) -> Column:
    r"""Content of the last ``\boxed{}`` that closes, its braces nested to any
    depth; null if none does.

    The text is cut at its braces.  From the right, the lowest balance of what
    follows a brace says whether it closes, so the last box that does is found
    in one pass, and where it ends in another; neither keeps a stack.
    """
    none = F.lit(None).cast("int")
    cut = F.struct(F.split(_c(x), "[{}]", -1).alias("between"), F.regexp_extract_all(_c(x), F.lit("[{}]"), 0).alias("braces"))

    def found(c: Column) -> Column:
        step = lambda b: F.when(b == "{", 1).otherwise(-1)
        opens = lambda b, k: (b == "{") & F.get(c["between"], k).endswith("\\boxed")
        events = F.transform(c["braces"], lambda b, k: F.struct(step(b).alias("e"), F.when(opens(b, k), k).alias("box"), k.alias("k")))

        def back(s: Column, v: Column) -> Column:
            at = F.coalesce(s["at"], F.when(s["low"] < 0, v["box"]))
            return F.struct((v["e"] + F.least(s["low"], F.lit(0))).alias("low"), at.alias("at"))

        start = F.aggregate(F.reverse(events), F.struct(F.lit(0).alias("low"), none.alias("at")), back)["at"]

        def forth(s: Column, v: Column) -> Column:
            depth = s["depth"] + F.when(v["k"] >= s["at"], v["e"]).otherwise(0)
            end = F.coalesce(s["end"], F.when((v["k"] > s["at"]) & (depth == 0), v["k"]))
            return F.struct(s["at"].alias("at"), depth.alias("depth"), end.alias("end"))

        return F.aggregate(events, F.struct(start.alias("at"), F.lit(0).alias("depth"), none.alias("end")), forth, lambda s: F.struct(c.alias("c"), s["at"].alias("at"), s["end"].alias("end")))

    def content(f: Column) -> Column:
        many = f["end"] - f["at"]
        texts = F.slice(f["c"]["between"], f["at"] + 2, many)
        ends = F.slice(F.concat(f["c"]["braces"], F.array(F.lit(""))), f["at"] + 2, many - 1)
        body = F.zip_with(texts, F.concat(ends, F.array(F.lit(""))), lambda t, b: F.concat(t, b))
        return F.when(f["end"].isNotNull(), F.array_join(body, ""))

    return F.get(F.transform(F.array(F.get(F.transform(F.array(cut), found), 0)), content), 0)


NUMBER = r"[-+]?\d*\.?\d+"


def tagged_number(x: Text) -> Column:
    """First number in the answer tag, commas removed."""
    inside = F.when(_c(x).rlike(r"(?is)<Answer>.*?</Answer>"), F.regexp_extract(_c(x), r"(?is)<Answer>\s*(.*?)\s*</Answer>", 1))
    return first_match(F.replace(inside, F.lit(","), F.lit("")), f"({NUMBER})").try_cast("double")


def first_token(x: Text) -> Column:
    """First token of the tagged answer or the text, trailing dots removed."""
    raw = F.coalesce(F.trim(answer_tag(x)), _c(x))
    return F.trim(F.regexp_replace(F.split_part(raw, F.lit(" "), F.lit(1)), r"\.+$", ""))


def judge_binary(x: Text) -> Column:
    """Verdict of a judge: 1 or 0, also as yes or no; null otherwise."""
    low = F.lower(F.trim(_c(x)))
    return F.when(low.startswith("1") | low.startswith("yes"), 1).when(low.startswith("0") | low.startswith("no"), 0)


def judge_score(x: Text, least: float = 0.0, most: float = 1.0) -> Column:
    """First number of a judge's text, within bounds; ``least`` without one."""
    value = first_match(x, r"(\d+(?:\.\d+)?)").try_cast("double")
    return F.coalesce(F.least(F.greatest(value, F.lit(least)), F.lit(most)), F.lit(least))


def judge_pair(x: Text) -> Column:
    """Struct of the two numbers on the first line; -1 each if it has not two."""
    parts = F.filter(F.split(F.replace(F.split_part(F.trim(_c(x)), F.lit("\n"), F.lit(1)), F.lit(","), F.lit(" ")), r"\s+"), lambda v: v != "")
    one, two = F.get(parts, 0).try_cast("double"), F.get(parts, 1).try_cast("double")
    good = (F.size(parts) == 2) & one.isNotNull() & two.isNotNull()
    return F.struct(F.when(good, one).otherwise(-1.0).alias("first"), F.when(good, two).otherwise(-1.0).alias("second"))


def judge_json(x: Text, schema: str) -> Column:
    """First JSON object inside the text; null if it cannot be read."""
    return F.from_json(F.regexp_extract(_c(x), r"(?s)\{.*\}", 0), schema)


def pairwise_verdict(x: Text) -> Column:
    """Struct raw (-2 to 2, for A positive), winner, label of ``[[A>>B]]``."""
    mark = first_match(x, r"\[\[(A>>B|A>B|A=B|B>A|B>>A)\]\]")
    raw = F.element_at(F.create_map(*(F.lit(v) for pair in (("A>>B", 2), ("A>B", 1), ("A=B", 0), ("B>A", -1), ("B>>A", -2)) for v in pair)), mark)
    winner = F.when(raw > 0, "A").when(raw < 0, "B").when(raw == 0, "tie")
    label = F.when(F.abs(raw) == 2, "much better").when(F.abs(raw) == 1, "better").when(raw == 0, "tie")
    return F.struct(raw.alias("raw"), winner.alias("winner"), label.alias("label"))


# --- normalisers (NRM1-NRM5) --------------------------------------------------

PUNCTUATION = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"


def exact_form(x: Text, drop: list[str] | None = None, case: bool = False, punctuation: bool = False, numbers: bool = False) -> Column:
    """Form for exact matching; each flag removes that difference."""
    out = _c(x)
    for pattern in drop or []:
        out = F.regexp_replace(out, pattern, "")
    out = F.lower(out) if case else out
    out = F.regexp_replace(out, PUNCTUATION, "") if punctuation else out
    return F.regexp_replace(out, "[0-9]", "") if numbers else out


# fixed values: number words of the question-answering form
NUMBER_WORDS = {
    "none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4",
    "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
}
ARTICLES = ("a", "an", "the")
# fixed values: contractions of the consensus form, as lower-case words meet them
CONTRACTIONS = {
    "aint": "ain't", "arent": "aren't", "cant": "can't", "couldve": "could've", "couldnt": "couldn't", "couldn'tve": "couldn't've",
    "couldnt've": "couldn't've", "didnt": "didn't", "doesnt": "doesn't", "dont": "don't", "hadnt": "hadn't", "hadnt've": "hadn't've",
    "hadn'tve": "hadn't've", "hasnt": "hasn't", "havent": "haven't", "hed": "he'd", "hed've": "he'd've", "he'dve": "he'd've", "hes": "he's",
    "howd": "how'd", "howll": "how'll", "hows": "how's", "isnt": "isn't", "itd": "it'd", "itd've": "it'd've", "it'dve": "it'd've", "itll": "it'll",
    "maam": "ma'am", "mightnt": "mightn't", "mightnt've": "mightn't've", "mightn'tve": "mightn't've", "mightve": "might've", "mustnt": "mustn't",
    "mustve": "must've", "neednt": "needn't", "notve": "not've", "oclock": "o'clock", "oughtnt": "oughtn't", "ow's'at": "'ow's'at",
    "'ows'at": "'ow's'at", "'ow'sat": "'ow's'at", "shant": "shan't", "shed've": "she'd've", "she'dve": "she'd've", "shouldve": "should've",
    "shouldnt": "shouldn't", "shouldnt've": "shouldn't've", "shouldn'tve": "shouldn't've", "somebody'd": "somebodyd", "somebodyd've": "somebody'd've",
    "somebody'dve": "somebody'd've", "somebodyll": "somebody'll", "somebodys": "somebody's", "someoned": "someone'd", "someoned've": "someone'd've",
    "someone'dve": "someone'd've", "someonell": "someone'll", "someones": "someone's", "somethingd": "something'd", "somethingd've": "something'd've",
    "something'dve": "something'd've", "somethingll": "something'll", "thats": "that's", "thered": "there'd", "thered've": "there'd've",
    "there'dve": "there'd've", "therere": "there're", "theres": "there's", "theyd": "they'd", "theyd've": "they'd've", "they'dve": "they'd've",
    "theyll": "they'll", "theyre": "they're", "theyve": "they've", "twas": "'twas", "wasnt": "wasn't", "wed've": "we'd've", "we'dve": "we'd've",
    "weve": "we've", "werent": "weren't", "whatll": "what'll", "whatre": "what're", "whats": "what's", "whatve": "what've", "whens": "when's",
    "whered": "where'd", "wheres": "where's", "whereve": "where've", "whod": "who'd", "whod've": "who'd've", "who'dve": "who'd've", "wholl": "who'll",
    "whos": "who's", "whove": "who've", "whyll": "why'll", "whyre": "why're", "whys": "why's", "wont": "won't", "wouldve": "would've",
    "wouldnt": "wouldn't", "wouldnt've": "wouldn't've", "wouldn'tve": "wouldn't've", "yall": "y'all", "yall'll": "y'all'll", "y'allll": "y'all'll",
    "yall'd've": "y'all'd've", "y'alld've": "y'all'd've", "y'all'dve": "y'all'd've", "youd": "you'd", "youd've": "you'd've", "you'dve": "you'd've",
    "youll": "you'll", "youre": "you're", "youve": "you've",
}
# fixed values: marks of the consensus form
MARKS = (";", "/", "[", "]", '"', "{", "}", "(", ")", "=", "+", "\\", "_", "-", ">", "<", "@", "`", "!")
#: Full stops that are removed at most; the form's definition stops there.
STOPS = 32


def vqa_form(x: Text) -> Column:
    """Form for consensus scoring.

    Lower case, without commas and question marks, ``'s`` a word of its own.  A
    mark that stands beside a space somewhere is removed, any other becomes a
    space; the first ``STOPS`` full stops that no digit follows are removed;
    number words become digits, articles go, contractions get their apostrophe.
    """
    text = F.replace(F.regexp_replace(F.lower(_c(x)), "[,?]", ""), F.lit("'s"), F.lit(" 's"))
    text = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"[\n\t]", " ")

    def marked(t: Column) -> Column:
        out = t
        for mark in MARKS:
            beside = t.contains(mark + " ") | t.contains(" " + mark)
            out = F.replace(out, F.lit(mark), F.when(beside, "").otherwise(" "))
        return out

    bare = F.get(F.transform(F.array(text), marked), 0)
    bare = F.array_join(F.split(bare, r"\.(?!\d)", STOPS + 1), "")
    numbers, contractions = (F.create_map(*(F.lit(v) for pair in t.items() for v in pair)) for t in (NUMBER_WORDS, CONTRACTIONS))
    # a map is searched from its start, the names of its keys by their hashes
    known = lambda w, names, table: F.when(w.isin(*names), F.try_element_at(table, w)).otherwise(w)
    words = F.transform(F.filter(F.split(bare, r"(?U)\s+"), lambda w: w != ""), lambda w: known(w, NUMBER_WORDS, numbers))
    words = F.filter(words, lambda w: ~w.isin(*ARTICLES))
    return F.array_join(F.transform(words, lambda w: known(w, CONTRACTIONS, contractions)), " ")


def qa_form(x: Text) -> Column:
    """Lower case, without ASCII punctuation and articles, single spaces."""
    bare = F.regexp_replace(F.lower(_c(x)), PUNCTUATION, "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), r"(?U)\s+", " "), "^ | $", "")


def speech_form(x: Text, characters: bool = False) -> Column:
    """Without ``<|...|>`` marks, single spaces; with ``characters`` each
    character is a token (languages written without spaces)."""
    text = F.trim(F.regexp_replace(F.regexp_replace(_c(x), r"<\|[^|]*\|>", ""), r"\s+", " "))
    return F.trim(F.regexp_replace(F.replace(text, F.lit(" "), F.lit("")), "(.)", "$1 ")) if characters else text


def stringified(x: Text) -> Column:
    """Nested values as JSON text."""
    return F.to_json(_c(x))


def subtitle_seconds(x: Text) -> Column:
    """``hh:mm:ss,ms`` in seconds; null if it has another form."""
    parts = F.split(F.replace(_c(x), F.lit(","), F.lit(".")), ":")
    hours, minutes, seconds = (F.get(parts, k).try_cast("double") for k in range(3))
    return F.when(F.size(parts) == 3, hours * 3600 + minutes * 60 + seconds)
