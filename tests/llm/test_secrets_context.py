import random
import string

import pytest

from lamella.llm import secrets

LETTERS, DIGITS = string.ascii_letters, string.digits


PRIMED = secrets.trained()


def novel(text):
    return [text[a:b] for a, b, _ in secrets.novel_spans(text, secrets.base_spans(text), PRIMED)]


@pytest.mark.parametrize("name", ["encryptionKey", "sessionKey", "signingKey", "stripeKey", "githubToken", "clientSecret", "dbPassword", "AWSSecret", "ENCRYPTION_KEY", "sessionkey"])
def test_names_in_any_case(name):
    rng = random.Random(1)
    for alphabet in (LETTERS + DIGITS, LETTERS):
        value = "".join(rng.choice(alphabet) for _ in range(40))
        assert novel(f'{name}, "{value}"') == [value]
        assert novel(f'put("{value}", {name})') == [value]


def test_short_letters_and_digits_alone():
    rng = random.Random(2)
    for alphabet in (LETTERS + DIGITS, LETTERS, DIGITS):
        for n in (12, 14, 15):  # 16 digits are a base kind
            value = "".join(rng.choice(alphabet) for _ in range(n))
            assert novel(f'signingKey, "{value}"') == [value]
            assert novel(f"sessionKey=> {value}") == [value]


def test_ordinary_words_stay():
    for word in ("fingerprints", "configuration", "authentication", "presentation", "milliseconds", "getElementById", "DocumentDirectory"):
        assert novel(f"the private key and the {word} they said") == []
    assert novel("the furniture came with a Xq7Lw9ZkPb2RtY4vNc8M they said") == []
