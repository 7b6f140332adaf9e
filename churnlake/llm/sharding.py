"""Shards of nearly equal bytes by histogram sort.

Documents are ordered by (hash of the text, hash of the id): copies of a text lie side by side, and the
order has nothing to do with the content. The borders of the shards are found without sorting: a pass
counts the exact bytes below evenly spaced probes inside every interval that still hides a border, and
the next pass sets its probes inside the one cell that the border must be in. The loop ends when the
bytes below a border are within the tolerance; where one text weighs more than that, the search goes on
among the ids of this text, so a text that a third of all rows share is cut like any other. Each pass
sends ``PROBES`` sums for each open interval to the driver, whatever the number of rows.

With the borders known, a row's shard is a comparison with constants, and rows are exchanged once, into
pieces of bounded size that number the rows of their shard.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlake.llm.common import pick
from churnlake.session import staged

KEYS = 2**63
PROBES = 256
#: Bytes that every document weighs besides its text.
ROW_BYTES = 16


@dataclass(frozen=True)
class Interval:
    """Keys low <= key < high; below: the bytes before it. With ``text`` set, keys are those of the ids of one text."""

    low: int
    high: int
    below: int
    text: int | None = None

    @property
    def step(self) -> int:
        return -(-(self.high - self.low) // PROBES)

    def holds(self) -> str:
        last = self.high - 1
        if self.text is None:
            return f"(text_key >= {self.low}L AND text_key <= {last}L)"
        return f"(text_key = {self.text}L AND id_key >= {self.low}L AND id_key <= {last}L)"

    def cell(self) -> str:
        key = "text_key" if self.text is None else "id_key"
        return f"({key} - {self.low}L) div {self.step}L"

    def border(self, cell: int) -> tuple[int, int]:
        at = min(self.high, self.low + cell * self.step)
        if self.text is None:
            return (at, 0)
        return (self.text, at) if at < KEYS else (self.text + 1, 0)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return pick(docs, doc_id=id_col, text=text_col).select(
        "*",
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 1).alias("text_key"),
        F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("id_key"),
    )


def _byte_counts(keys: DataFrame, intervals: list[Interval]) -> dict[int, dict[int, int]]:
    """Bytes in each cell of each interval, exactly, from one pass."""
    number = "CASE " + " ".join(f"WHEN {x.holds()} THEN {i}" for i, x in enumerate(intervals)) + " END"
    cell = "CASE number " + " ".join(f"WHEN {i} THEN {x.cell()}" for i, x in enumerate(intervals)) + " END"
    counted = (
        keys.withColumn("number", F.expr(number))
        .where("number IS NOT NULL")
        .groupBy("number", F.expr(cell).alias("cell"))
        .agg(F.sum("size").alias("bytes"))
    )
    found: dict[int, dict[int, int]] = {i: {} for i in range(len(intervals))}
    for row in counted.collect():  # at most PROBES rows for each interval
        found[row["number"]][row["cell"]] = row["bytes"]
    return found


def find_borders(keys: DataFrame, targets: list[int], tolerance: float) -> list[tuple[int, int]]:
    """For each target the key (text, id) below which nearly ``target`` bytes lie.

    keys: text_key, id_key (0 <= key < 2**63) and size. A border is off by more than ``tolerance`` bytes
    only where rows of one text and one id weigh more.
    """
    done: dict[int, tuple[int, int]] = {}
    at = {target: Interval(0, KEYS, 0) for target in targets}
    while at:
        intervals = list(dict.fromkeys(at.values()))
        counts = _byte_counts(keys, intervals)
        following = {}
        for target, interval in at.items():
            below, cells = interval.below, counts[intervals.index(interval)]
            cell, weight = 0, 0
            for cell in sorted(cells):
                weight = cells[cell]
                if below + weight > target:
                    break
                below += weight
            else:
                below, weight = below - weight, weight
            nearer = cell if target - below <= below + weight - target else cell + 1
            if min(abs(target - below), abs(below + weight - target)) <= tolerance:
                done[target] = interval.border(nearer)
            elif interval.step > 1:
                low = interval.low + cell * interval.step
                following[target] = Interval(low, min(interval.high, low + interval.step), below, interval.text)
            elif interval.text is None:
                following[target] = Interval(0, KEYS, below, interval.low + cell)
            else:
                done[target] = interval.border(nearer)
        at = following
    return [done[target] for target in targets]


def _shard_of(borders: list[tuple[int, int]]) -> Column:
    """The number of borders at or below a row's key: a balanced tree of comparisons."""

    def tree(first: int, last: int) -> str:
        if first == last:
            return str(first)
        middle = (first + last) // 2
        text, number = borders[middle]
        if text >= KEYS:
            return tree(first, middle)
        test = f"text_key > {text}L OR (text_key = {text}L AND id_key >= {number}L)"
        return f"IF({test}, {tree(middle + 1, last)}, {tree(first, middle)})"

    return F.expr(f"CAST({tree(0, len(borders))} AS INT)")


def shard_documents(
    docs: DataFrame,
    shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    tolerance: float = 0.001,
    piece_rows: int = 500_000,
) -> DataFrame:
    """doc_id, text, size, text_crc32, law, shard, slot of every row.

    size: UTF-8 bytes of the text and 16. Shards 0 to ``shards`` - 1 have nearly equal sums of size: a
    border is off by at most ``tolerance`` of a shard, or by one row. slot: from 0 without gaps in each
    shard. Copies of a text meet in one shard, except where a border cuts them.

    A null text weighs 16 bytes and has the crc32 of the empty text; a null id is an id like any other.
    Repeated rows (same id and text) are counted and stay together. An empty table gives no rows. Other
    columns are ignored, whatever their names.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    rows = _keyed(docs, id_col, text_col)
    keys = staged(rows.select("text_key", "id_key", "size"), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    targets = [total * i // shards for i in range(1, shards)]
    borders = find_borders(keys, targets, tolerance * total / shards) if total else []
    placed = keys.withColumn("shard", _shard_of(sorted(borders)))
    most = placed.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    piece = F.pmod("id_key", F.lit(max(1, math.ceil(most / piece_rows)))).cast("int")
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", piece.alias("piece"))
        .count()
        .select("shard", "piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy("shard", "piece").orderBy("text_key", "id_key")
    return (
        rows.withColumn("shard", _shard_of(sorted(borders)))
        .withColumn("piece", piece)
        .withColumn("place", F.row_number().over(within))
        .join(offsets, ["shard", "piece"])
        .select(
            "doc_id",
            "text",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"),
        )
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard; rows keep their slot."""
    sharded.write.partitionBy("shard").parquet(path)
