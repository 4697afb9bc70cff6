"""The trie encoder against the library that owns the format, and edge cases."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm.bpe import TOKENIZERS, TrieEncoder, encode, token_counts, vocabulary

FILE = os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary here")


@pytest.fixture(scope="module")
def encoder():
    with open(FILE, "rb") as f:
        return TrieEncoder(vocabulary(f.read()))


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def ids(encoder, text):
    offsets, flat = encoder.encode_texts([text])
    return flat[offsets[0] : offsets[1]].tolist()


CASES = ["", " ", "\n\n  \r\n x", "it's he'll I'VE", "<|endoftext|>", "a\x1cb", "½ ² Ⅷ ４", "　 x​", "a" * 5000, " " * 700, "=" * 999, "नमस्ते 👩‍👩‍👧 𝔘", "func (s *Svc) GetUser(ctx context.Context) error {\n\treturn nil\n}", "0123456789" * 50]


@pytest.mark.parametrize("text", CASES)
def test_cases(encoder, reference, text):
    assert ids(encoder, text) == reference(text)


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_any_text(encoder, reference, text):
    text = text.encode("utf-8", "ignore").decode()
    assert ids(encoder, text) == reference(text)


def test_borders_equal_the_merges(encoder):
    rng = random.Random(2)
    ranks = sorted(encoder.tokens)
    short = [t for t in ranks if len(encoder.tokens[t]) <= 3][:3000]
    same = [encoder.ranks[c * n] for c in (b"a", b" ", b"=", b"-", b"0") for n in range(1, 9) if c * n in encoder.ranks]
    pairs = [(rng.choice(ranks), rng.choice(ranks)) for _ in range(3000)] + [(rng.choice(short), rng.choice(short)) for _ in range(20000)] + [(a, b) for a in same for b in same]
    for a, b in pairs:
        assert encoder.may_follow(a, b) == (encoder.merged(encoder.tokens[a] + encoder.tokens[b]) == [a, b]), (encoder.tokens[a], encoder.tokens[b])


def test_words_sharing_prefixes(encoder, reference):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcde ") for _ in range(rng.randint(1, 25))) for _ in range(400)]
    offsets, flat = encoder.encode_texts(words)
    for i, w in enumerate(words):
        assert flat[offsets[i] : offsets[i + 1]].tolist() == reference(w)


def test_forgetting_changes_nothing(reference, monkeypatch):
    import lodestone.llm.bpe as m

    monkeypatch.setattr(m, "WORDS_KEPT", 3)
    with open(FILE, "rb") as f:
        e = TrieEncoder(vocabulary(f.read()))
    for t in ("one two three four five", "five six seven", "one two"):
        assert ids(e, t) == reference(t)


def test_frame(spark, reference):
    df = spark.createDataFrame([(1, "Hello  world"), (2, None), (3, ""), (1, "Hello  world"), (None, "x")], "doc_id long, text string").selectExpr("*", "0 AS key", "'q' AS ids")
    got = sorted(((r["key"], r["ids"]) for r in encode(df, "doc_id", "text").collect()), key=str)
    assert got == sorted([(1, reference("Hello  world")), (1, reference("Hello  world")), (2, []), (3, []), (None, reference("x"))], key=str)
    assert sorted(r["n"] for r in token_counts(df, "doc_id", "text").collect()) == [0, 0, 1, 3, 3]
    assert encode(df.limit(0), "doc_id", "text").count() == 0
