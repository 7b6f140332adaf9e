"""Sets of 64-bit codes as bitmaps of bounded size: they spare rows a shuffle, and a join behind them decides."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The largest bitmap that is sent to all tasks (16 MB), and the largest that becomes a broadcast table.
MOST_BITS, TABLE_BITS = 1 << 27, 1 << 22


def bit_count(codes: int, most: int = MOST_BITS) -> int:
    """Sixteen bits a code, as a power of two from 2^16 to ``most``."""
    return min(most, max(1 << 16, 1 << (16 * codes).bit_length()))


def _words(codes: DataFrame, bits: int) -> DataFrame:
    """word, bits: the set bits of the codes in the first column."""
    spot = f"(`{codes.columns[0]}` & {bits - 1}L)"
    words = codes.selectExpr(f"shiftright({spot}, 6) AS word", f"shiftleft(1L, int({spot} & 63)) AS bit")
    return words.groupBy("word").agg(F.expr("bit_or(bit)").alias("bits"))


def bitmap(codes: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of the codes in the first column; ``bits`` is a power of two."""
    out = np.zeros(bits // 64, np.int64)
    words = _words(codes, bits).toArrow()
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def holds(words: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For each code, whether its bit is set. A code of the set always holds, others by chance."""
    spots = codes.view(np.int64) & (len(words) * 64 - 1)
    return (words[spots >> 6] >> (spots & 63) & 1).astype(bool)


def marked(rows: DataFrame, code: Column, codes: DataFrame, name: str) -> DataFrame:
    """``rows`` with a column ``name``: whether the bit of ``code`` is set in a bitmap of ``codes``. The bitmap is a
    broadcast table of at most ``TABLE_BITS`` bits (65,536 rows)."""
    words = _words(codes, TABLE_BITS).withColumnRenamed("word", "bitmap_word").withColumnRenamed("bits", "bitmap_bits")
    spot = code.bitwiseAND(F.lit(TABLE_BITS - 1))
    joined = rows.join(F.broadcast(words), F.shiftright(spot, 6) == F.col("bitmap_word"), "left")
    test = F.call_function("shiftright", F.col("bitmap_bits"), spot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))
    return joined.withColumn(name, F.coalesce(test == 1, F.lit(False))).drop("bitmap_word", "bitmap_bits")
