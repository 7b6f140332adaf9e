"""Token ids in files: one zstandard dictionary for all, one frame for each document.

Documents are exchanged once, by ranges of their id, and each task writes one file in ascending id order:

    magic | frames, one for each document | index | trailer

The index holds, for each document, its id, whether the id is null, where its frame begins and its number
of ids; the trailer says where the index begins and holds the SHA-256 of the dictionary. A document is
read with the index and its own frame only. The dictionary is trained on the serialized ids of
``SAMPLE_DOCS`` documents with the smallest hashes (of each at most ``SAMPLE_IDS`` ids); it is stored
beside the files under its hash. A retried task writes a file of another name; the manifest, a Parquet
table that Spark commits, names the files that count.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlake.llm.bpe import read_definition
from churnlake.llm.common import kept, pick, share, slices
from churnlake.session import new_path, slice_count

MAGIC = b"TOKENZ01"
TRAILER = "<QQB32s"
END_ID = 1
SAMPLE_DOCS = 2000
SAMPLE_IDS = 8192
DICTIONARY_BYTES = 112 << 10
CACHE_WORDS = 500_000
#: The pattern by which the vocabulary's pieces are cut.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"""
#: Scripts whose letters, small letters and normal forms are the same in every Unicode version in use, without
#: separators other than those of ASCII.
UNSETTLED = "[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-\u012f\u0131-\u024f\u0400-\u0482\u048a-\u052f\u2010-\u2027\u2030-\u205e\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]"


class WordTokenizer:
    """A vocabulary file of the tokenizers library for lower-cased words that end in a mark.

    No token spans white space, so a text is put together from its chunks between white space. A chunk of
    settled characters is in turn the words, digits and runs of signs that the file's own pattern cuts, and
    the library encodes each of those once. Chunks with other characters, and texts that hold an
    added token, go to the library as they are.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        data = json.loads(definition)
        self.added = [t["content"] for t in data["added_tokens"]]
        mark = data["model"]["end_of_word_suffix"]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in data["model"]["vocab"].items() if token.endswith(mark)]] = True
        self.pattern, self.unsettled = regex.compile(PIECES), re.compile(UNSETTLED)
        self.known: dict[str, bytes] = {}

    def _learn(self, chunks: set[str]) -> None:
        """Encode chunks of settled characters. All new pieces go to the library as one text; the marked
        tokens tell where each piece ends."""
        known, signs, new = self.known, {}, set()
        for chunk in chunks:
            if chunk not in known:
                if chunk.isalpha():  # one piece
                    new.add(chunk)
                else:
                    signs[chunk] = parts = self.pattern.findall(chunk)
                    new.update(p for p in parts if p not in known)
        if new:
            ids = np.array(self.tokenizer.encode(" ".join(new), add_special_tokens=False).ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) != len(new):
                raise ValueError("the vocabulary does not mark the ends of words")
            raw = ids.tobytes()
            known.update(zip(new, [raw[i:j] for i, j in zip([0, *cuts], cuts)]))
        for chunk, parts in signs.items():
            known[chunk] = b"".join([known[p] for p in parts])

    def _learn_other(self, chunks: set[str]) -> None:
        missing = [chunk for chunk in chunks if chunk not in self.known]
        coded = self.tokenizer.encode_batch_fast(missing, add_special_tokens=False)
        self.known.update((chunk, np.array(e.ids, "<u4").tobytes()) for chunk, e in zip(missing, coded))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut, settled, other = [], set(), set()
        for text in texts:
            if any(content in text for content in self.added):
                cut.append([text])
                other.add(text)
            elif self.unsettled.search(text):
                cut.append(text.split(" "))
                other.update(cut[-1])
            else:
                cut.append(text.lower().split())
                settled.update(cut[-1])
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        self._learn(settled)
        self._learn_other(other)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, chunks)), "<u4") for chunks in cut]


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary for these arrays; none if they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


class TokenFile:
    """Reads one file; ``documents`` yields all, ``ids`` one by its position in the index."""

    def __init__(self, uri: str, dictionary: bytes):
        system, path = open_folder(uri)
        self.file = system.open_input_file(path)
        size, trailer = self.file.size(), struct.calcsize(TRAILER)
        at, count, width, digest = struct.unpack(TRAILER, self._at(size - trailer, trailer))
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        index = self._at(at, size - trailer - at)
        parts, place = [], 0
        for kind, n in (("<i8", count), ("<u1", count), ("<u8", count + 1), ("<u8", count)):
            parts.append(np.frombuffer(index, kind, n, place))
            place += parts[-1].nbytes
        self.doc_ids, self.null, self.offsets, self.lengths = parts
        self.kind = f"<u{width}"
        self.decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def doc_id(self, i: int) -> int | None:
        return None if self.null[i] else int(self.doc_ids[i])

    def ids(self, i: int) -> np.ndarray:
        frame = self._at(int(self.offsets[i]), int(self.offsets[i + 1] - self.offsets[i]))
        size = int(self.lengths[i]) * int(self.kind[2:])
        return np.frombuffer(self.decompressor.decompress(frame, max_output_size=size), self.kind).astype("<u4")

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of the documents with this id: one binary search, then their frames."""
        known = self.doc_ids[int(self.null.sum()) :]  # null ids stand first
        first = len(self) - len(known)
        low, high = np.searchsorted(known, [doc_id, doc_id + 1])
        return [self.ids(i) for i in range(first + int(low), first + int(high))]

    def close(self) -> None:
        self.file.close()


def write_token_files(
    docs: DataFrame,
    vocabulary: str,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    files: int | None = None,
) -> tuple[DataFrame, str]:
    """Write the ids of all rows; return the manifest (part, path, n_docs, n_ids) and the folder.

    The ids of a document end with ``end_id``; a null or empty text is that id alone. Rows are ordered by
    (id, hash of the text), null ids first, so repeated ids are written each. An empty table gives no
    file and an empty manifest. folder: a URI that every executor can write to; by default a new one in
    the shared folder of the session. files: how many, by default the session's shuffle partitions.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    folder = folder or new_path(spark, "token-files")
    definition = read_definition(vocabulary)
    words = json.loads(definition)
    definition = share(context, definition)
    largest = max([*words["model"]["vocab"].values(), *(t["id"] for t in words["added_tokens"]), end_id])
    width = 2 if largest < 1 << 16 else 4
    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = rows.select(rows.doc_id.cast("long"), F.coalesce(rows.text.cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]

    def serialize(tokenizer: WordTokenizer, texts: list[str]) -> Iterator[tuple[bytes, int]]:
        for ids in tokenizer.encode(texts):
            yield np.append(ids, end_id).astype(f"<u{width}").tobytes(), len(ids) + 1

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = None
        for batch in slices(batches):
            tokenizer = tokenizer or kept(definition, WordTokenizer)
            coded = [ids[: SAMPLE_IDS * width] for ids, _ in serialize(tokenizer, batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(coded, pa.binary())], ["ids"])

    mark = F.xxhash64("doc_id", "text")
    last = rows.select(mark.alias("mark")).orderBy("mark").limit(SAMPLE_DOCS).agg(F.max("mark")).first()[0]
    # only texts up to the last mark travel; the limit counts where repeated rows share it
    chosen = rows.where(mark <= F.lit(last).cast("long")).limit(SAMPLE_DOCS).select("text")
    trained = train_dictionary([bytes(r["ids"]) for r in chosen.mapInArrow(sample, "ids binary").collect()])
    digest = hashlib.sha256(trained).digest()
    system, path = open_folder(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/dictionary-{digest.hex()}") as out:
        out.write(trained)
    shared = context.broadcast(trained)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = out = None
        part, place = TaskContext.get().partitionId(), len(MAGIC)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        doc_ids, null, offsets, lengths = [], bytearray(), [], []
        for batch in slices(batches):
            if out is None:
                tokenizer = kept(definition, WordTokenizer)
                system, path = open_folder(folder)
                out = system.open_output_stream(f"{path}/{name}")
                out.write(MAGIC)
                compressor = zstandard.ZstdCompressor(dict_data=_dictionary(shared.value))
            for doc_id, (data, n) in zip(batch.column(0).to_pylist(), serialize(tokenizer, batch.column(1).to_pylist())):
                frame = compressor.compress(data)
                out.write(frame)
                doc_ids.append(doc_id or 0)
                null.append(doc_id is None)
                offsets.append(place)
                lengths.append(n)
                place += len(frame)
        if out is None:
            return
        for kind, values in (("<i8", doc_ids), ("<u1", list(null)), ("<u8", [*offsets, place]), ("<u8", lengths)):
            out.write(np.array(values, kind).tobytes())
        out.write(struct.pack(TRAILER, place, len(doc_ids), width, hashlib.sha256(shared.value).digest()))
        out.close()
        yield pa.RecordBatch.from_pydict(
            {"part": [part], "path": [f"{folder}/{name}"], "n_docs": [len(doc_ids)], "n_ids": [sum(lengths)]}
        )

    manifest = (
        rows.repartitionByRange(files or slice_count(spark), *order)
        .sortWithinPartitions(*order)
        .mapInArrow(write, "part long, path string, n_docs long, n_ids long")
    )
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest"), folder


def read_token_files(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids binary (little-endian unsigned 32-bit integers) of every document.

    start: the ids of all documents before it. Each task reads whole files; a file whose dictionary hash
    is not that of the dictionary in the folder is refused.
    """
    system, path = open_folder(folder)
    names = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("dictionary-")]
    with system.open_input_stream(names[0]) as file:
        shared = spark.sparkContext.broadcast(file.read())
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = TokenFile(uri, shared.value)
                for first in range(0, len(file), 512):
                    each = range(first, min(first + 512, len(file)))
                    lengths = [int(file.lengths[i]) for i in each]
                    starts = start + np.concatenate(([0], np.cumsum(lengths)))
                    start = int(starts[-1])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([file.doc_id(i) for i in each], pa.int64()),
                            pa.array(starts[:-1], pa.int64()),
                            pa.array(lengths, pa.int64()),
                            pa.array([file.ids(i).tobytes() for i in each], pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )
                file.close()

    return placed.repartition(slice_count(spark), "path").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids binary"
    )
