import random

import pytest

from scorewright.llm import secrets

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = {"hex": DIGITS + "ABCDEF", "base32": UPPER + "234567", "lower": LOWER + DIGITS, "base64": UPPER + LOWER + DIGITS + "+/", "url": UPPER + LOWER + DIGITS + "-_"}


def keys(alphabet, n, count, rng):
    while count:
        key = "".join(rng.choices(alphabet, k=n))
        if any(c.isdigit() for c in key) and any(c.isalpha() for c in key):
            count -= 1
            yield key


def novel(text):
    return [text[s["start"] : s["end"]] for s in secrets.secret_spans(text) if s["kind"] == "novel"]


@pytest.mark.parametrize("name", ALPHABETS)
@pytest.mark.parametrize("n", [16, 24, 32, 48, 64, 128, 256, 1024, 4096])
def test_random_keys_of_any_length_are_found(name, n):
    rng = random.Random(n)
    for key in keys(ALPHABETS[name], n, 20, rng):
        assert novel(f"def connect(client): return client.login(user)\nAuthorization: Bearer {key}\nprint(client)") == [key]
        assert novel(f"private_key <- '{key}'") == [key]


def test_padding_is_part_of_the_key():
    rng = random.Random(5)
    for key in keys(ALPHABETS["base32"], 250, 10, rng):
        assert novel(f"Authorization: Bearer {key}======") == [key + "======"]


def test_dotted_tokens_are_one_span():
    rng = random.Random(6)
    parts = [next(keys(ALPHABETS["url"], n, 1, rng)) for n in (90, 6, 200, 43)]
    token = ".".join(parts)
    assert novel(f"Authorization: Bearer {token}.") == [token]
    assert secrets.redact(f"Bearer {token}.", secrets.secret_spans(f"Bearer {token}.")) == "Bearer [SECRET]."
    # a part that is a fixed kind does not hide the others
    mixed = f"{'0123456789abcdef' * 2}.{parts[3]}"
    assert novel(f"Authorization: Bearer {mixed}") == [mixed]
    assert novel("Authorization: Bearer build_0123456789abcdef0123") == []


def test_dotted_and_long_words_stay():
    for name in ("client.session.login.user2.value", "configuration1configuration2configuration3.initialization", "example_token_value_1_" * 12, "0123456789ABCDEF" * 8):
        assert novel(f"Authorization: Bearer {name}") == []
