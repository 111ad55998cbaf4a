import random
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tesserae.llm.bpe import decode, encode, encoder, round_trip

PATH = public_tokenizers.path("byte_bpe_50k.json")
library = Tokenizer.from_file(PATH)


def ids(text):
    p = encoder(PATH).packed(text)
    return list(struct.unpack(f"<{len(p) // 4}I", p))


def same(text):
    want = library.encode(text, add_special_tokens=False).ids
    assert ids(text) == want
    assert encoder(PATH).decode([encoder(PATH).packed(text)])[0].decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text())
def test_any_text(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abtheinors '\n\t.1é　\x1c\x85​", max_size=80))
def test_near_vocabulary(text):
    same(text)


def test_every_code_point_class():
    rng = random.Random(1)
    for _ in range(600):
        same("".join(chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(rng.randrange(1, 12))))


@pytest.mark.parametrize("text", ["", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "a" * 100_000, "ab" * 30_000, " " * 5000 + "x", "don't we'll I'M", "\n\n \t\nx", "https://x.example/a?b=c&d=e#f", "日本語のテキスト", "🙂" * 300])
def test_cases(text):
    same(text)


def test_frames(spark):
    rows = [(1, "hello world", 9), (1, "hello world", 9), (2, None, 9), (3, "", 9), (None, "x <|endoftext|>", 9), (4, "word " * 60_000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    both = round_trip(df, PATH).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in both) == sorted((i or 0, t or "") for i, t, _ in rows)
    back = decode(encode(df, PATH), PATH).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in back) == sorted((i or 0, t or "") for i, t, _ in rows)
    for r in both:
        n = len(r.ids) // 4
        assert list(struct.unpack(f"<{n}I", bytes(r.ids))) == library.encode(r.decoded, add_special_tokens=False).ids
    assert round_trip(df.limit(0), PATH).count() == 0
