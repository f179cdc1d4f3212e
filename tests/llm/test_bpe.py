import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm.bpe import TOKENIZERS, CorpusEncoder, encoded, read_ranks

PATH = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")

HARD = [
    "", " ", "\n\n  x", "<|endoftext|> is text", "it's THEY'LL don't 'tis", "a\r\nb\tc\x1c\x1d d\x85e\xa0f g　h", "naïve ÀÉÎ café", "日本語のテキスト。你好,世界", "😀👩‍👩‍👧 \u200b\ufeff", "x" * 5000, "=" * 3000,
    "ab" * 4000, "1234567890 ١٢٣ Ⅷ ½", "\x00\x01 nul", "tabs\t\t\tand   spaces   ", "e\u0301 o\u0308", "𝒳𝒴 \U0001f1e9\U0001f1ea",
]


@pytest.fixture(scope="module")
def encoder():
    return CorpusEncoder(read_ranks(PATH))


@pytest.fixture(scope="module")
def reference():
    import sys

    sys.path.insert(0, os.path.dirname(os.path.realpath(TOKENIZERS)))
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    ranks = {t: i for i, t in enumerate(read_ranks(PATH))}
    a = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    b.encode_special_tokens = True
    return lambda text: (a.encode_ordinary(text), b.encode(text, add_special_tokens=False).ids)


def ids(encoder, texts):
    offsets, values = encoder.ids(texts)
    return [values[offsets[i] : offsets[i + 1]].tolist() for i in range(len(texts))]


def test_hard_texts_equal_both_libraries(encoder, reference):
    for text, got in zip(HARD, ids(encoder, HARD)):
        assert (got, got) == reference(text), text[:40]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_equals_both_libraries(encoder, reference, text):
    got = ids(encoder, [text])[0]
    assert (got, got) == reference(text)
    assert b"".join(encoder.replay.tokens[i] for i in got).decode() == text


def test_documents(spark):
    rows = [(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (4, "hello world", "x"), (5, "long " * 40_000, "x"), (None, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in encoded(df, path=PATH).collect()}
    assert got[1] == got[4] == [31373, 995] and got[2] == got[3] == [] and len(got[5]) > 40_000 and got[None] == [64]
    assert encoded(df.limit(0), path=PATH).count() == 0
