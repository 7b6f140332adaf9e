"""Benchmark decontamination with one Aho-Corasick automaton over words.

Questions and answers are normalised to words. Every distinct benchmark word gets a letter of its own,
so a window of ten words is a key of ten letters, and a document becomes a string with one letter for each
word (one common letter for words that no item has). The automaton runs once over that string; a match
ends at a word, and word positions map back to character offsets of the original text.

The benchmark is sent to the executors in blocks of at most ``BLOCK_BYTES`` of text. One block is the
usual case; more blocks are further automata in the same narrow pass, so the work stays exact and the
memory bounded whatever the size of the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.llm.common import WORD_BYTES, keep_rows, kept, pick, share, slices

WINDOW = 10
BLOCK_BYTES = 2 << 20
OTHER = "\x00"
HITS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class WindowAutomaton:
    """All windows of a block of items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.letters: dict[bytes, str] = {}
        keys: dict[str, set[str]] = {}
        for item, text in items:
            words = text.translate(WORD_BYTES).split()
            coded = "".join(self._letter(w) for w in words)
            for i in range(max(1, len(coded) - window + 1) if coded else 0):
                keys.setdefault(coded[i : i + window], set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for key, owners in keys.items():
            self.automaton.add_word(key, (len(key), tuple(owners)))
        if keys:
            self.automaton.make_automaton()
        self.empty = not keys

    def _letter(self, word: bytes) -> str:
        if word not in self.letters:
            code = len(self.letters) + 1
            self.letters[word] = chr(code if code < 0xD800 else code + 0x800)  # surrogates are no letters
        return self.letters[word]

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """(first word, word after the last, items) of every occurrence of a window."""
        if self.empty or not words:
            return
        for end, (size, owners) in self.automaton.iter("".join(map(self.letters.get, words, repeat(OTHER)))):
            yield end + 1 - size, end + 1, owners


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ascending ranges that cover the same positions."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def character_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[dict]:
    """Character offsets in the original text of ranges of words."""
    if not ranges:
        return []
    inside = np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    characters = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [{"start": int(characters[starts[a]]), "end": int(characters[ends[b - 1]])} for a, b in ranges]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """The items, block after block; the driver holds one block at a time."""
    items = pick(benchmark, item=item_col, text=text_col).select(
        F.coalesce(F.col("item").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("binary")
    )
    items = items.where(F.octet_length("text") > 0)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-2 * size // BLOCK_BYTES) if size > BLOCK_BYTES else 1
    for number in range(count):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == number) if count > 1 else items
        yield [(row["item"], bytes(row["text"])) for row in block.collect()]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """doc_id, n_words, n_hit, items array<string>, spans array<struct<start, end>> of every row.

    A window is ``window`` consecutive words of an item; an item with fewer words, but not none, is one
    window. A word of the document that lies in an occurrence of a window is hit. items: the distinct ids
    of items with occurring windows, sorted; a null id is the text ``null``. spans: character offsets of
    the hit passages in the original text, disjoint and ascending.

    Null and empty texts have no words; items without words match nothing. An empty benchmark gives rows
    without hits, an empty table no rows. Repeated rows are scanned each for itself; two items with equal
    text are both reported. Other columns are ignored.
    """
    context = docs.sparkSession.sparkContext
    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = rows.select(rows.doc_id.cast("long"), rows.text.cast("binary").alias("text"))
    state = rows.select(
        "doc_id",
        "text",
        F.expr("CAST(array() AS array<struct<first: bigint, last: bigint>>)").alias("hits"),
        F.expr("CAST(array() AS array<string>)").alias("items"),
    )
    result = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start: bigint, end: bigint>>"
    blocks = _blocks(benchmark, item_col, item_text_col)
    block = next(blocks, [])
    while block is not None:
        following = next(blocks, None)
        scan = _scanner(share(context, block), window, last=following is None)
        state = state.mapInArrow(scan, result if following is None else state.schema)
        block = following
    return state


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """The rows without any window of an item, with all their columns: those that ``find_contamination`` gives no
    hits. Each row is judged by its own text; a text is left at its first match."""
    context, clean = docs.sparkSession.sparkContext, docs
    for block in _blocks(benchmark, item_col, item_text_col):
        clean = keep_rows(clean, text_col, _no_match(share(context, block), window))
    return clean


def _no_match(shared, window: int):
    def make_test():
        windows = kept(shared, lambda items: WindowAutomaton(items, window))
        return lambda text: next(windows.matches(text.translate(WORD_BYTES).split()), None) is None

    return make_test


def _scanner(shared, window: int, last: bool):
    """A pass over texts with the automaton of one block: adds hit ranges and items; the last one finishes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = None
        for batch in slices(batches):
            windows = windows or kept(shared, lambda items: WindowAutomaton(items, window))
            texts = batch.column(1).to_pylist()
            counts, hits, items = [], [], []
            for text, before, met in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = (text or b"").translate(WORD_BYTES).split()
                ranges, owners = [(r["first"], r["last"]) for r in before], set(met)
                for first, end, found in windows.matches(words):
                    owners.update(found)
                    if ranges and ranges[-1][0] <= first <= ranges[-1][1]:
                        ranges[-1] = (ranges[-1][0], max(end, ranges[-1][1]))
                    else:
                        ranges.append((first, end))
                counts.append(len(words))
                hits.append(merged(ranges))
                items.append(sorted(owners))
            names = pa.array(items, pa.list_(pa.string()))
            if not last:
                told = pa.array([[{"first": a, "last": b} for a, b in r] for r in hits], HITS)
                columns, labels = [batch.column(0), batch.column(1), told, names], ["doc_id", "text", "hits", "items"]
            else:
                hit = pa.array([sum(b - a for a, b in r) for r in hits], pa.int64())
                spans = pa.array([character_spans(t, r) for t, r in zip(texts, hits)], SPANS)
                columns = [batch.column(0), pa.array(counts, pa.int64()), hit, names, spans]
                labels = ["doc_id", "n_words", "n_hit", "items", "spans"]
            yield pa.RecordBatch.from_arrays(columns, labels)

    return run
