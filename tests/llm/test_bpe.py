import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def ids(text):
    return memoryview(bpe.codec(PATH).encode(text)).cast("I").tolist()


CASES = ["", " ", "a", "Hello world's  best\n\n  ", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "é ñ ß 漢字 👩‍👩‍👧 ", "a" * 3000, "ab" * 2000 + " " * 500 + "x", "  x​", "123 ٣٤ Ⅷ", "\x00\x1c\x1d\x85 a"]


@pytest.mark.parametrize("text", CASES)
def test_as_the_library(library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert ids(text) == want
    assert bpe.codec(PATH).decode(bpe.codec(PATH).encode(text)) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, text):
    assert ids(text) == library.encode(text, add_special_tokens=False).ids


def test_every_code_point(library):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1 {c}" for c in chars[i : i + 500]) for i in range(0, len(chars), 500)]
    bad = [i for i, (t, e) in enumerate(zip(texts, library.encode_batch(texts, add_special_tokens=False))) if ids(t) != e.ids]
    assert not bad


def test_table(spark, library):
    rows = [(1, "one two", 9), (2, None, 9), (3, "", 9), (1, "one two", 9), (4, "tie" * 5000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(tuple(r) for r in bpe.encode_decode(df, PATH).collect())
    want = sorted((i, len(e := library.encode(t or "", add_special_tokens=False).ids), b"".join(x.to_bytes(4, "little") for x in e), t or "") for i, t, _ in rows)
    assert [(a, b, bytes(c), d) for a, b, c, d in got] == want
    assert bpe.encode_decode(df.limit(0), PATH).count() == 0


def test_documents(spark, library):
    from tidemark.llm.queries import op1_bpe

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op1_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        e = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(e)
        assert r.ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in e)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest()
