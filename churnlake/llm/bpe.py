"""Byte-level BPE encoding and decoding with a contiguous rank array.

A word's bytes stay in place. ``bounds`` holds where its parts begin, ``ranks`` the rank of merging each
part with the next. A step scans ``ranks`` for the first minimum, deletes the boundary between the two
parts and looks up the two ranks that changed. Words are short, so scanning an array beats a heap; words
over ``LONG_WORD`` bytes take a heap over linked parts, which merges in the same order. The words of a
texts repeat, so each worker keeps the ids of words that it has met; over ``CACHE_WORDS`` it starts anew.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from churnlake.llm.common import kept, list_column, pick, share, slices

LONG_WORD = 256
CACHE_WORDS = 250_000
MAX_VOCABULARY_BYTES = 64 << 20
#: The pattern that splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Scripts whose letters and digits are the same in every Unicode version in use. A text with other
#: characters is split by the tokenizers library, whose tables decide what counts as a letter.
SETTLED = regex.compile("[^\x00-ԯ -⁤ぁ-ゖァ-ヺ一-龥가-힣]")
NEVER = 1 << 60
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("decoded", T.StringType()),
    ]
)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: printable bytes stand for themselves,
    the others follow from code point 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """A vocabulary file of the tokenizers library (byte-level BPE without normalizer)."""

    def __init__(self, definition: str):
        data, letters = json.loads(definition), byte_letters()
        model = data["model"]
        spelled = lambda token: bytes(letters[c] for c in token)
        self.vocabulary = {spelled(token): i for token, i in model["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(spelled(a), spelled(b)): rank for rank, (a, b) in enumerate(pairs)}
        added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.added = added
        longest_first = sorted(added, key=len, reverse=True)
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        self.spelling = {i: word for word, i in self.vocabulary.items()}
        self.spelling |= {i: content.encode() for content, i in added.items()}
        self.pattern = regex.compile(PATTERN)
        self.words: dict[str, bytes] = {}
        self.library_split = None

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        if len(word) > LONG_WORD:
            return self._merge_long(word)
        bounds = list(range(len(word) + 1))
        rank = lambda i: self.ranks.get((word[bounds[i] : bounds[i + 1]], word[bounds[i + 1] : bounds[i + 2]]), NEVER)
        ranks = [rank(i) for i in range(len(word) - 1)]
        while ranks and (least := min(ranks)) != NEVER:
            i = ranks.index(least)
            del bounds[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(i)
            if i:
                ranks[i - 1] = rank(i - 1)
        return [self.vocabulary[word[a:b]] for a, b in zip(bounds, bounds[1:])]

    def _merge_long(self, word: bytes) -> list[int]:
        size = len(word)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        alive = [True] * size

        def push(i: int) -> None:
            j = after[i]
            if j < size:
                rank = self.ranks.get((word[i:j], word[j : after[j]]))
                if rank is not None:
                    heapq.heappush(heap, (rank, i, j, after[j]))

        heap: list[tuple[int, int, int, int]] = []
        for i in range(size):
            push(i)
        while heap:
            _, i, j, end = heapq.heappop(heap)
            if not (alive[i] and after[i] == j and j < size and alive[j] and after[j] == end):
                continue
            alive[j] = False
            after[i] = end
            if end < size:
                before[end] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        starts = [i for i in range(size) if alive[i]]
        return [self.vocabulary[word[i : after[i]]] for i in starts]

    def split(self, text: str) -> list[str]:
        if not SETTLED.search(text):
            return self.pattern.findall(text)
        if self.library_split is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self.library_split = ByteLevel(add_prefix_space=False, use_regex=True)
        return [text[a:b] for _, (a, b) in self.library_split.pre_tokenize_str(text)]

    def _known(self, pieces: list[str]) -> bytes:
        words = self.words
        try:
            return b"".join(map(words.__getitem__, pieces))
        except KeyError:
            if len(words) > CACHE_WORDS:
                words.clear()
            for piece in set(pieces):
                if piece not in words:
                    words[piece] = struct.pack(f"<{len(ids := self.merge(piece.encode()))}i", *ids)
            return b"".join(map(words.__getitem__, pieces))

    def encode(self, text: str) -> np.ndarray:
        if self.added_pattern is None or not self.added_pattern.search(text):
            return np.frombuffer(self._known(self.split(text)), "<i4")
        parts = []
        for part in self.added_pattern.split(text):
            if part in self.added:
                parts.append(np.array([self.added[part]], "<i4").tobytes())
            else:
                parts.append(self._known(self.split(part)))
        return np.frombuffer(b"".join(parts), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.spelling.__getitem__, ids.tolist())).decode("utf-8", "replace")


def read_definition(path: str) -> str:
    """A vocabulary file, read on the driver; its size bounds what is broadcast."""
    with open(path, "rb") as file:
        data = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is over {MAX_VOCABULARY_BYTES} bytes")
    return data.decode("utf-8")


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded string of every row: the ids of the text, and the text they spell.

    vocabulary: path of a vocabulary file. Added tokens of the file are recognised inside texts. A null
    or empty text has no ids and decodes to the empty text. Repeated rows and null ids stay as they are;
    other columns are ignored. Rows stay in their partition; nothing is shuffled.
    """
    shared = share(docs.sparkSession.sparkContext, read_definition(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for batch in slices(batches):
            bpe = bpe or kept(shared, ByteBpe)
            coded = [bpe.encode(text or "") for text in batch.column(1).to_pylist()]
            decoded = [bpe.decode(ids) for ids in coded]
            flat = np.concatenate(coded) if coded else np.zeros(0, "<i4")
            ids = list_column(flat, map(len, coded), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), ids, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"]
            )

    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = rows.select(rows.doc_id.cast("long"), rows.text.cast("string"))
    return rows.mapInArrow(run, SCHEMA)
