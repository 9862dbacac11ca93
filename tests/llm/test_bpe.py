import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from symgraph.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
CODEC = bpe.codec(PATH, PATTERN)
WANT = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
TEXTS = ["", " ", "a  b", " a", "a ", "a\n\nb", "a \n b", "it's 12345 we'll", "héllo wörld\nß 日本語🙂", "\x00\x01 \u00a0x\u2028y", "<|endoftext|>", "x" * 5000, "Ab, cd.\nEf gh\tij"]


@pytest.mark.parametrize("text", TEXTS)
def test_as_tiktoken(text):
    ids = CODEC.encode(text)
    assert ids == WANT.encode_ordinary(text) and CODEC.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="ab1 ,.'\n\t", max_size=80))
def test_any_text(text):
    assert CODEC.encode(text) == WANT.encode_ordinary(text)


def test_other_patterns_and_small_memo(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 8)
    own = bpe.Codec(PATH, PATTERN)
    text = " ".join(f"word{i} x{i}\ny" for i in range(200))
    assert own.encode_many([text, text, "a  b"]) == [WANT.encode_ordinary(t) for t in (text, text, "a  b")]
    plain = bpe.Codec(PATH, r"\S+|\s+")
    assert plain.decode(plain.encode(text)) == text.encode()


def test_very_long_text_goes_in_parts(monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 100)
    monkeypatch.setattr(bpe, "CHUNK", 7)
    text = "Some words, 123 of them.\n " * 40
    assert bpe.Codec(PATH, PATTERN).encode(text) == WANT.encode_ordinary(text)


def test_frame(spark):
    df = spark.createDataFrame([(1, "Hello there", 9), (2, None, 9), (2, "", 9), (None, "x", 9)], "doc_id long, text string, ids int")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op2_bpe(df, PATH, PATTERN).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {(i, len(x := WANT.encode_ordinary(t)), sha(",".join(map(str, x)).encode()), sha(t.encode())) for i, t in [(1, "Hello there"), (2, ""), (None, "x")]}
    assert got == want
    enc = bpe.encode(df, PATH, PATTERN)
    assert {bytes(r.decoded) for r in bpe.decode(enc, PATH, PATTERN).collect()} == {b"Hello there", b"", b"x"}
    assert bpe.op2_bpe(df.limit(0), PATH, PATTERN).count() == 0
