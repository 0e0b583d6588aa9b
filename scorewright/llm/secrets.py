"""Secret scan: fixed patterns, and novelty under a primed compressor.

Fixed patterns find assignments, access keys and long hex strings.  The
method measures each candidate, which is the value of a fixed kind or what
stands soon after a sensitive word: a run of key characters, with dots or
without, or a string in quotes.  Its novelty is its marginal size under
zstandard over that of random characters of the same alphabet and length, the
smaller of two: with the code around it as dictionary, and behind content that
is coded like identifiers (``Prime``).  Novel candidates are reported beside the
fixed kinds, which stay whatever their novelty.

The compressor leaves a string of this length as it is, so identifiers that a
dictionary does not hold literally would look as random as keys.  Therefore
candidates are measured as the end of a longer input, and in a code in which
the 128 most frequent letter pairs of identifiers are one byte and a capital is
a mark and its small letter: names of any kind take fewer and more frequent
bytes, key material does not.
"""

from __future__ import annotations

import builtins
import functools
import importlib
import keyword
import random
import re
import statistics
import sys
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.llm.rows import named, with_arrow_columns

# fixed values: patterns of the base kinds, in their order
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of 16 and more: a run ends only where the class does
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

# fixed values: words that make a context sensitive
SENSITIVE = (
    "password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "api key",
    "access_key", "access-key", "access key", "private_key", "private-key", "private key", "credential",
    "authorization", "bearer", "signature", "client_id", "connectionstring",
)
_SENSITIVE = re.compile("|".join(map(re.escape, SENSITIVE)), re.IGNORECASE | re.ASCII)
#: Least characters of a candidate run, and of a candidate in quotes.
LEAST_RUN, LEAST_QUOTED = 16, 12
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_RUN)
#: Candidates and shorter parts joined by dots, as in signed tokens.
_DOTTED = re.compile(r"[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*")
_QUOTES = "\"'`"
#: A string in quotes with signs that end a run, as in passwords (no address, path or template).
_QUOTED = re.compile(r"""[\"'`](?=[A-Za-z0-9+=_-]*[!#$%%^&*?~])([A-Za-z0-9!#$%%^&*?~+=_-]{%d,})[\"'`]""" % LEAST_QUOTED)
_STARTS = re.compile(r"""[\"'`A-Za-z0-9+/_=-]""")
_WHOLE = re.compile(r"\S+")
_SIGNS = re.compile(r"[!#$%^&*?~]")
#: Characters after a sensitive word in which a candidate, or what it is dotted to, may start.
REACH = 64
#: Characters on either side of a candidate that prime the compressor.
AROUND = 256
#: Share of the size of random characters that a candidate must have when compressed.
LEAST_NOVELTY = 0.82

# fixed values: identifiers and placeholders that prime the compressor
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key secret_key private_key public_key client_secret "
    "client_id authorization bearer credentials username user_name session cookie signature certificate "
    "AWS_ACCESS_KEY_ID AWS_SECRET_ACCESS_KEY GITHUB_TOKEN DATABASE_URL CONNECTION_STRING process.env os.environ "
    "getenv config settings environment variable example sample placeholder changeme your_api_key_here "
    "your-token-here insert_token_here REPLACE_ME TODO dummy test_token null None undefined true false "
    "import export return function class const static public private protected string integer boolean "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef 1234567890 "
    "00000000000000000000000000000000 ffffffffffffffffffffffffffffffff xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx "
    "XXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXX -------------------------------- ================================ "
    "application/json content-type text/plain https://www. http://localhost .example.com/ /api/v1/ base64 utf-8 "
    "validation authentication configuration initialization implementation documentation "
)


# fixed values: alphabets of key material, the narrowest that holds a candidate is its own
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = (
    _DIGITS, _DIGITS + "abcdef", _DIGITS + "ABCDEF", _DIGITS + "abcdefABCDEF", _UPPER + "234567", _LOWER + "234567",
    _UPPER + _DIGITS, _LOWER + _DIGITS, _UPPER + _LOWER + _DIGITS,
)


def base_values(text: str) -> list[tuple[int, int, int, int]]:
    """``start, kind, end, value`` of the fixed kinds, each leftmost and without
    overlaps of its own kind; matches that are too short are dropped.  ``value``
    is where the secret itself starts."""
    low, found = text.lower(), []
    if any(x in low for x in ("passw", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of the fixed kinds."""
    return [x[:3] for x in base_values(text)]


def _alphabet(body: str) -> str:
    """The narrowest alphabet of a string; signs other than letters and digits
    join it as they occur."""
    held = set(body)
    signs = "".join(sorted(held - set(ALPHABETS[-1])))
    return next(x for x in ALPHABETS if held <= {*x, *signs}) + signs


def random_like(candidate: str, draw: int = 0) -> str:
    """Random characters of a candidate's alphabet and length; padding stays."""
    body = candidate.rstrip("=") or candidate
    return "".join(random.Random(len(body) + (draw << 32)).choices(_alphabet(body), k=len(body))) + candidate[len(body) :]


def novelty(candidate: str, around: str) -> float:
    """Marginal compressed bytes of a candidate over those of random characters.

    Copies of the candidate in ``around`` are left out, else a secret that is
    written twice would explain itself.  The compressor codes an alphabet in
    fewer bits than bytes have, the better the longer a string is, so a fixed
    share of the length would drop long keys.
    """
    primed = (IDENTIFIERS + around.replace(candidate, " ")).encode("utf-8", "surrogatepass")
    press = zstandard.ZstdCompressor(
        level=19,
        dict_data=zstandard.ZstdCompressionDict(primed, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
        write_checksum=False,
        write_content_size=False,
        write_dict_id=False,
    )
    empty, own, drawn = (len(press.compress(x.encode())) for x in ("", candidate, random_like(candidate)))
    return (own - empty) / (drawn - empty)


# fixed values: modules of the standard library whose names are identifiers as people write them
MODULES = (
    "argparse ast asyncio base64 calendar codecs collections configparser csv ctypes datetime decimal difflib email errno fileinput "
    "functools gettext glob gzip hashlib html http.client imaplib inspect io ipaddress json locale logging logging.handlers mailbox "
    "mimetypes multiprocessing os pathlib pickle platform plistlib queue select shelve shutil signal smtplib socket sqlite3 ssl stat "
    "statistics string subprocess tarfile tempfile textwrap threading tokenize traceback types typing unicodedata unittest "
    "unittest.mock urllib.parse urllib.request uuid warnings weakref xml.dom xml.etree.ElementTree zipfile"
)
# fixed values: paths and platform names that stand in many texts
PATHS = (
    "/usr/lib/python3/dist-packages/ /usr/local/lib/ /usr/local/bin/ /usr/share/ /etc/ssl/certs/ /var/lib/ /var/log/ /home/user/ /opt/ /tmp/ "
    "site-packages node_modules/ x86_64-unknown-linux-gnu x86_64-linux-gnu aarch64-apple-darwin amd64 arm64 utf8mb4_unicode_ci "
    "multilingual-cased-uncased-base-large-v1 -snapshot -backup -release -latest "
)
#: Bytes that stand for letter pairs: those that no folded text has.
CODES = [*range(32), *range(65, 91), *range(127, 256)]
#: Symbols of each content, contents, and bytes of the dictionary.
CONTENT, CONTENTS, DICTIONARY = 1500, 5, 80_000
#: Random strings whose mean size a candidate is compared with (two for those of more than 4096 characters).
DRAWS = 12


def standard_identifiers() -> list[str]:
    """Names of the standard library, of its classes' members and of the language."""
    found = {*keyword.kwlist, *dir(builtins), *sys.stdlib_module_names}
    for name in MODULES.split():
        module = importlib.import_module(name)
        for member in dir(module):
            found.add(member)
            own = getattr(module, member, None)
            if isinstance(own, type):
                found.update(dir(own))
    return sorted(x for x in (y.strip("_") for y in found) if len(x) > 2)


def _folded(text: str) -> str:
    return re.sub("[A-Z]", lambda m: "^" + m[0].lower(), text)


class Prime:
    """Content that codes identifiers well: made on the driver, a few kilobytes
    and a dictionary of ``DICTIONARY`` bytes, and sent to the tasks.

    ``words`` are parts of the corpus' own identifiers (``corpus_words``).  The
    identifiers of the standard library are cut into parts, and parts of both
    are joined again in the usual styles, with numbers and dates.
    """

    def __init__(self, words: tuple[str, ...] = ()) -> None:
        rng = random.Random(1)
        names = standard_identifiers()
        parts = Counter(x.lower() for n in names for x in re.findall("[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", n) if len(x) > 2)
        known = [w for w, _ in parts.most_common(6000)]
        samples = [*names, *(IDENTIFIERS.split() + PATHS.split()) * 5, *map(str, range(0, 1000, 7)), *(f"v{n}" for n in range(1, 30))]
        samples += [f"{y}-{m:02d}-{d:02d}T{(y * m + d) % 24:02d}-{(m * d) % 60:02d}-{(y + d) % 60:02d}" for y in range(1998, 2031) for m, d in ((1, 1), (3, 9), (5, 17), (7, 22), (9, 28), (11, 30), (12, 31))]
        for k in range(6000):
            own = [rng.choice(words if words and k % 3 == 0 else known) for _ in range(rng.randint(2, 5))]
            if rng.random() < 0.4:
                own.insert(rng.randint(1, len(own)), str(rng.randint(0, 999)))
            style = rng.random()
            samples.append("_".join(own) if style < 0.35 else "".join(p.title() for p in own) if style < 0.7 else ("-" if style < 0.85 else "/").join(own))
        rng.shuffle(samples)
        folded = [_folded(x) for x in samples]
        counts = Counter(t[k : k + 2] for t in folded for k in range(len(t) - 1) if t[k] != "^")
        self.pairs = dict(zip(sorted(counts, key=lambda p: (-counts[p], p)), CODES, strict=False))
        coded = [self.code(x) for x in samples]
        self.dictionary = b" ".join([*map(self.code, words), *coded])[:DICTIONARY]
        symbols, self.contents = list(b"".join(coded)), []
        for _ in range(CONTENTS):  # shuffled, so that only their frequencies count
            rng.shuffle(symbols)
            self.contents.append(bytes(symbols[:CONTENT]) + b" ")
        self.expected: dict[tuple, float] = {}
        self.press = self.empty = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"press": None, "empty": None}

    def code(self, text: str) -> bytes:
        """Bytes of a text: pairs as one, other characters as they are."""
        text, out, at, pairs = _folded(text), bytearray(), 0, self.pairs
        while at < len(text):
            pair = pairs.get(text[at : at + 2])
            if pair is None:
                out.append(ord(text[at]) if text[at] < "\x80" else 63)
                at += 1
            else:
                out.append(pair)
                at += 2
        return bytes(out)

    def size(self, text: str) -> float:
        """Mean marginal bytes of a text behind the contents."""
        if self.press is None:
            held = zstandard.ZstdCompressionDict(self.dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=19)
            self.press = zstandard.ZstdCompressor(dict_data=held, level=19, write_checksum=False, write_content_size=False, write_dict_id=False)
            self.empty = [len(self.press.compress(c)) for c in self.contents]
        coded = self.code(text)
        return statistics.mean(len(self.press.compress(c + coded)) - n for c, n in zip(self.contents, self.empty, strict=True))

    def novelty(self, candidate: str) -> float:
        body = candidate.rstrip("=") or candidate
        key = (_alphabet(body), len(body), len(candidate))
        if key not in self.expected:
            draws = range(DRAWS if len(candidate) <= 4096 else 2)
            self.expected[key] = statistics.mean(self.size(random_like(candidate, k)) for k in draws)
        return self.size(candidate) / self.expected[key]


@functools.cache
def standard_prime() -> Prime:
    return Prime()


#: Words of the corpus that prime the compressor at most, and documents that have them at least.
WORDS, LEAST_DOCUMENTS = 4096, 3


def corpus_words(docs: DataFrame, text_col: str = "text", most: int = WORDS, least: int = LEAST_DOCUMENTS) -> tuple[str, ...]:
    """The parts of identifiers and words that most documents have: runs of 3
    to 12 letters, at most ``most`` of them, in at least ``least`` documents.
    (Runs of letters, so that a key which is copied does not explain itself.)"""
    parts = F.regexp_extract_all(named(text_col).cast("string"), F.lit("[A-Z]?[a-z]{2,11}(?![a-z])|[A-Z]{3,12}(?![A-Za-z])"), 0)
    words = docs.select(F.explode(F.array_distinct(F.transform(parts, lambda w: F.lower(w)))).alias("w"))
    counts = words.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return tuple(r["w"] for r in counts.orderBy(F.desc("n"), "w").limit(most).collect())


def _classes(value: str) -> bool:
    """Whether a value has letters and digits, as key material does."""
    return bool(re.search("[0-9]", value) and re.search("[A-Za-z]", value))


def _share(text: str, start: int, end: int, prime: Prime) -> float:
    """Novelty of a candidate: the smaller of that under the prime and that
    beside the text around it, which is measured only where it may decide."""
    found = prime.novelty(text[start:end])
    around = text[max(0, start - AROUND) : start] + text[end : end + AROUND]
    return found if found < LEAST_NOVELTY else min(found, novelty(text[start:end], around))


def contexts(text: str) -> Iterator[tuple[int, int]]:
    """Candidates: what begins at most ``REACH`` characters after a sensitive
    word and is a quoted string or a run of key characters with dots.

    No character is looked at twice, however many sensitive words there are.
    """
    at = 0
    for word in _SENSITIVE.finditer(text):
        at = max(at, word.end())
        while at <= word.end() + REACH:
            found = _STARTS.search(text, at, min(len(text), word.end() + REACH + 1))
            if not found:
                break
            whole = (_QUOTED.match(text, found.start()) if found[0] in _QUOTES else None) or _DOTTED.match(text, found.start())
            if whole is None:  # a mark that opens no string
                at = found.end()
                continue
            at = whole.end()
            yield whole.span(1) if whole.re is _QUOTED else whole.span()


def novel_spans(text: str, known: list[tuple[int, int, int]], prime: Prime) -> tuple[list[tuple[int, int, int, float]], int]:
    """Candidates that are novel and that no known span explains, and how many
    were measured.  They do not overlap one another.

    Assignments and access keys explain what they touch; hex runs, which a
    longer key of digits and capitals may contain, explain a candidate of
    which they leave fewer than 16 characters.  Of parts joined by dots, one
    novel part makes the whole a span.
    """
    found, measured = [], 0
    # spans of one kind are disjoint, so starts and ends of a kind are both in order
    by_kind = [[(a, b) for a, k, b in known if k == kind] for kind in range(3)]
    sides = [([a for a, _ in x], [b for _, b in x]) for x in by_kind]

    def free(start: int, end: int) -> bool:
        on = [x[bisect_right(ends, start) : bisect_left(starts, end)] for x, (starts, ends) in zip(by_kind, sides, strict=True)]
        if on[0] or on[1]:
            return False
        return not on[2] or end - start - sum(min(b, end) - max(a, start) for a, b in on[2]) >= LEAST_RUN

    for start, end in contexts(text):
        one = bool(_SIGNS.search(text, start, end))  # a string in quotes is measured as a whole
        parts = []
        for m in (_WHOLE if one else _CANDIDATE).finditer(text, start, end):
            if _classes(m[0]) and free(*m.span()):
                measured += 1
                share = _share(text, *m.span(), prime)
                if share >= LEAST_NOVELTY:
                    parts.append((m.start(), 3, m.end(), share))
        if parts and free(start, end):
            parts = [(start, 3, end, max(x[3] for x in parts))]
        found += parts
    return found, measured


def measured_spans(text: str | None, prime: Prime | None = None) -> tuple[list[dict], int]:
    """All spans of a text by start, then kind (code points, end exclusive),
    and the number of strings whose novelty was measured.

    Null is taken as empty.  The values of the fixed kinds (what an assignment
    assigns, whole keys and runs) are measured too, but stay whatever it says.
    """
    text, prime = text or "", prime or standard_prime()
    base = base_values(text)
    every = [(a, k, b, _share(text, v, b, prime)) for a, k, b, v in base]
    measured = len(every)
    low = text.lower()
    if any(x in low for x in SENSITIVE):
        novel, more = novel_spans(text, [x[:3] for x in base], prime)
        every, measured = sorted(every + novel, key=lambda x: x[:2]), measured + more
    return [{"kind": KINDS[k], "start": a, "end": b, "novelty": s} for a, k, b, s in every], measured


def secret_spans(text: str | None) -> list[dict]:
    return measured_spans(text)[0]


_SPANS = "array<struct<kind:string,start:bigint,end:bigint,novelty:double>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))


def redact(text: str | None, spans: list[dict], mark: str = "[SECRET]") -> str | None:
    """The text with every span, overlapping ones as one, replaced by a mark."""
    if text is None or not spans:
        return text
    out, at, end = [], 0, -1
    for x in sorted(spans, key=lambda x: x["start"]):
        if x["start"] < end:
            end = max(end, x["end"])
            at = end
            continue
        out += [text[at : x["start"]], mark]
        at = end = x["end"]
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, text_col: str = "text", redacting: bool = True, keep: list[str] | None = None) -> tuple[DataFrame, list[Column]]:
    """Rows with ``spans`` (kind, start, end, novelty), ``n_measured`` and,
    with ``redacting``, the ``redacted`` text.

    The second result selects the columns of ``docs`` (those in ``keep``, if
    given) back, whatever their names.  Each row is handled alone: repeated
    rows, empty and null texts and empty tables need no case of their own; a
    null text stays null.  The compressor is primed with the words that most
    documents have, which are read first (``corpus_words``).
    """
    prime = Prime(corpus_words(docs, text_col))

    def start():
        def make(texts: list) -> list[pa.Array]:
            found = [measured_spans(t, prime) for t in texts]
            new = [pa.array([s for s, _ in found], _SPAN_TYPE), pa.array([n for _, n in found], pa.int64())]
            if redacting:
                new.append(pa.array([redact(t, s) for t, (s, _) in zip(texts, found, strict=True)], pa.string()))
            return new

        return make

    fields = f"spans {_SPANS}, n_measured bigint" + (", redacted string" if redacting else "")
    return with_arrow_columns(docs, [named(text_col).cast("string")], start, fields, keep)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans,
    n_novel, n_measured, novelty`` (of each span, in their order).

    A null or empty text has no spans; repeated rows all come back; an empty
    table gives an empty result.
    """
    found, back = find_secrets(docs, text_col, redacting=False, keep=[id_col])
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] != "novel")
    return found.select(
        back[0].alias("doc_id"),
        *(n(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        n("novel").alias("n_novel"),
        "n_measured",
        F.array_join(F.transform("spans", lambda x: F.format_number(x["novelty"], 2)), ",").alias("novelty"),
    )


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with secrets replaced in the text, and its length renewed.

    Every row stays; a null text stays null, and a text without secrets as it
    is, with its length.  An empty table gives an empty result.
    """
    found, back = find_secrets(docs, text_col)
    out = dict(zip(docs.columns, back, strict=True))
    out[text_col] = F.col("redacted").alias(text_col)
    if length_col in out:
        kind = docs.schema[length_col].dataType
        changed = F.size("spans") > 0
        at = docs.columns.index(length_col)
        out[length_col] = F.when(changed, F.length("redacted").cast(kind)).otherwise(F.col(f"c{at}")).alias(length_col)
    return found.select(*out.values())
