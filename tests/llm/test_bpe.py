import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from churnlake.llm.bpe import SETTLED, ByteBpe, encode_decode, read_definition

PATH = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe(read_definition(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(bpe, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert bpe.encode(text).tolist() == ids
    assert bpe.decode(bpe.encode(text)) == library.decode(ids, skip_special_tokens=False) == text


def test_special_tokens_and_long_words(bpe, library):
    pick = random.Random(1)
    long = "".join(pick.choices("abcdefghiЖ", k=5000))
    for text in ("a<|endoftext|>b <|endoftext|><|endoftext|>", long, " " * 3000, "1" * 700 + long[:300], "don't we'll\r\n\t  x  "):
        assert bpe.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_both_ways_of_merging_agree(bpe):
    pick = random.Random(2)
    for _ in range(200):
        word = " ".join(pick.choices(["ab", "the", "ing", "É", "zz"], k=pick.randrange(1, 12))).replace(" ", "").encode()
        assert bpe._merge_long(word) == bpe.merge(word)


def test_settled_characters_split_alike(bpe):
    split = ByteLevel(add_prefix_space=False, use_regex=True)
    for code in range(0x110000):
        if 0xD800 <= code < 0xE000 or SETTLED.search(chr(code)):
            continue
        text = f"a{chr(code)}b {chr(code)}{chr(code)} 1"
        assert bpe.pattern.findall(text) == [text[a:b] for _, (a, b) in split.pre_tokenize_str(text)], hex(code)


def test_rows(spark, documents, odd_rows, library):
    got = encode_decode(documents(odd_rows), PATH).collect()
    expected = [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in odd_rows]
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    assert encode_decode(documents([]), PATH).collect() == []
