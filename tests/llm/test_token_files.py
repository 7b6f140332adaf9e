import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from churnlake.llm.token_files import TokenFile, WordTokenizer, open_folder, read_token_files, write_token_files
from churnlake.llm.bpe import read_definition

PATH = "/opt/tokenizers/word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(rows, library):
    coded = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows]
    out, start = [], 0
    for i, ids in sorted(coded, key=lambda r: (r[0] is not None, r[0] or 0)):
        out.append((i, start, len(ids), ids))
        start += len(ids)
    return out


def read(spark, docs, **options):
    manifest, folder = write_token_files(docs, PATH, **options)
    rows = read_token_files(spark, manifest, folder).collect()
    found = [(r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in rows]
    return sorted(found, key=lambda r: r[1]), manifest, folder


def test_round_trip(spark, documents, small, library):
    rows = [(r.doc_id, r.text) for r in small("documents").select("doc_id", "text").collect()]
    found, manifest, folder = read(spark, documents(rows).repartition(4), files=5)
    assert found == expected(rows, library)
    system, path = open_folder(folder)
    from pyarrow import fs

    name = next(f for f in system.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("dictionary-"))
    dictionary = open(name.path, "rb").read()
    assert dictionary  # trained, as there is enough text
    file = TokenFile(manifest.orderBy("part").first().path, dictionary)
    doc = expected(rows, library)[3]
    assert [ids.tolist() for ids in file.find(doc[0])] == [doc[3]]
    assert file.find(10**12) == []
    with pytest.raises(ValueError):
        TokenFile(manifest.first().path, b"another")


def test_odd_rows(spark, documents, odd_rows, library):
    rows = [*odd_rows, (11, "<|startoftext|>Hi<|endoftext|> ΌΣΟΣ İ ﬁ é  x")]
    found, _, _ = read(spark, documents(rows))
    assert [r[1:3] for r in found] == [(sum(x[2] for x in found[:i]), r[2]) for i, r in enumerate(found)]
    key = lambda r: (str(r[0]), r[2], r[3])
    strip = lambda r: (r[0], 0, r[2], r[3])
    assert sorted(map(strip, found), key=key) == sorted(map(strip, expected(rows, library)), key=key)
    assert read(spark, documents([]))[0] == []


@pytest.fixture(scope="module")
def tokenizer():
    return WordTokenizer(read_definition(PATH))


def same(tokenizer, library, texts):
    for text, ids in zip(texts, tokenizer.encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_pieces_equal_whole_texts(tokenizer, library):
    same(tokenizer, library, ["a\tb\n\nc", "don't  STOP 123,4 'S''s", "x y z\u0301 \u0301w", "\u00e9" * 50 + " ok<|endoftext|>", "", " "])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x24F), st.characters(codec="utf-8")), max_size=40), max_size=5))
def test_any_text(tokenizer, library, texts):
    same(tokenizer, library, texts)


def test_settled_characters(tokenizer, library):
    settled = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and not tokenizer.unsettled.search(chr(c))]
    for start in range(0, len(settled), 400):
        same(tokenizer, library, [f"a{c}b {c}{c} 1{c}\u00e9" for c in settled[start : start + 400]])
