"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext, cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions of this subpackage travel to the executors with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules["churnlake.llm"])

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words of letters, digits and all non-ASCII characters, as a Java regular expression.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Lower-cases A-Z and blanks every ASCII byte that is no letter or digit; bytes from 0x80 on stay.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Rows that a Python worker holds at once as Python objects.
SLICE_ROWS = 256


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """The columns ``wanted`` (new name = old name) and no others.

    Columns are found by position, so other columns whose names differ only in case, or hold dots,
    do no harm.
    """
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"c{names.index(old)}").alias(new) for new, old in wanted.items()])


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def id_remainder(doc_id: Column, modulus: int = 5) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def sha256_text(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def share(context: SparkContext, data) -> Broadcast:
    """Broadcast ``data`` for ``kept``."""
    return context.broadcast({"data": data})


def kept(shared: Broadcast, make: Callable):
    """``make(data)`` of a broadcast of ``share``, built once in a worker process and kept for its later tasks."""
    value = shared.value
    if "made" not in value:
        value["made"] = make(value["data"])
    return value["made"]


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in pieces whose texts (binary, in ``column``) have some ``most`` bytes; a longer text is a piece of its own."""
    for batch in batches:
        ends = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            end = max(start + 1, int(ends.searchsorted(before + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def keep_rows(docs: DataFrame, text_col: str, make_test: Callable[[], Callable[[bytes], bool]]) -> DataFrame:
    """The rows of ``docs`` whose text passes a test, with all their columns, in one narrow pass.

    make_test is called once in each task and gives the test; a null text is tested as the empty one.
    Rows are told apart by position only, so ids and names of other columns may be null, repeated or alike.
    """
    names = docs.columns
    at = names.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = make_test()
        for batch in slices(batches):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([test(text or b"") for text in texts], pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*names)


def list_column(values, lengths, kind: pa.DataType) -> pa.ListArray:
    """A list column from its flat values and the length of each list."""
    offsets = [0]
    for n in lengths:
        offsets.append(offsets[-1] + n)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
