"""Removal of repeated byte windows: a depth-limited radix sort of suffixes, digit by digit.

Suffixes are ordered only through the ``window`` bytes that decide; equal groups are the repeated windows, and
a suffix that stands alone after a digit takes no part in the next one. What is shuffled is never a row for
each suffix:

*First digit.* The least of a window's grams (runs of some 32 bytes, by hash, leftmost of equals) is its most
significant digit. Neighbouring windows share it, so the windows of a text fall into short strips, one for each
anchor gram; equal windows have equal anchors at equal offsets. One count for each gram drops the strips
whose anchor occurs once in all texts.

*Second digit.* Of the rest, strips that are equal as a whole are repeated as a whole. Only where one anchor has strips
that differ, one strip of each kind goes on, with its bytes.

*Further digits.* Strips of one anchor meet in one task; their windows are sorted by five digits, and singles drop
after each. An anchor with more than ``GROUP`` strips is first dealt out by further digits: its windows are halved by
their offset, and the bytes that all windows of a half share make the next digit. Halves that are equal as a whole are
repeated as a whole, and one of each kind goes on, down to single windows, whose group needs a count only.

Digits are 64-bit hashes of the bytes they stand for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.llm.bitmaps import bit_count, bitmap, holds, marked
from churnlake.llm.common import kept, pick, share, slices
from churnlake.session import staged

WINDOW = 200
#: Window starts that are looked at together; positions inside take ``SPOT_BITS``.
CHUNK, SPOT_BITS = 1 << 20, 21
#: Strips of one anchor that one task sorts, and windows that it sorts at a time.
GROUP, BLOCK_WINDOWS = 10_000, 1_000_000
#: Anchors that a task adds up before it passes them on, and marks of texts and strips that it remembers.
BLOCK_ANCHORS, REMEMBERED = 1_000_000, 500_000
DIGITS = 5
SPAN = "struct<start: bigint, end: bigint>"


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + (a >> np.uint64(29)))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(31)
    return out


#: A code for each byte value.
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64), np.arange(1, 257, dtype=np.uint64) << np.uint64(40))


def run_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` bytes, by doubling."""
    out, size = BYTE_CODES[data], 1
    while 2 * size <= length:
        out, size = mix(out[:-size], out[size:]), 2 * size
    rest = length - size
    return mix(out[:-rest], out[rest:]) if rest else out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values, from the least so far of blocks, both ways."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def gram_size(window: int) -> int:
    return 1 << max(0, (window // 6).bit_length() - 1)


def strips(text: bytes, window: int) -> tuple[np.ndarray, ...]:
    """first, end, anchor, gram, whole: the strips of a text. A strip holds the windows that start from ``first``
    and end by ``end``; their anchor gram starts at ``anchor``; ``whole`` is the hash of the strip's bytes."""
    data, gram = np.frombuffer(text, np.uint8), gram_size(window)
    width, low = window - gram + 1, np.uint64((1 << SPOT_BITS) - 1)
    out = []
    for start in range(0, len(data) - window + 1, CHUNK):
        part = data[start : start + CHUNK + window - 1]
        codes = run_hashes(part, gram)
        spots = np.arange(len(codes), dtype=np.uint64)
        least = sliding_least(codes & ~low | spots, width) & low
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        end = np.append(first[1:], len(least)) + window - 1
        anchor = least[first].astype(np.int64)
        out.append((first + start, end + start, anchor + start, codes[anchor]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    first, end, anchor, codes = (np.concatenate(c) for c in zip(*out))
    view = memoryview(text)
    whole = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), end.tolist())), np.uint64, len(first))
    return first, end, anchor, codes.view(np.int64), whole.view(np.int64)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint ascending spans that cover the same places."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    opens = np.concatenate(([True], starts[1:] > reach[:-1])) if len(starts) else np.zeros(0, bool)
    return starts[opens], reach[np.append(np.flatnonzero(opens)[1:] - 1, len(reach) - 1)] if len(starts) else reach


class _Seen(set):
    """What a task has met; forgets all at a fixed size, which costs work only."""

    def new(self, mark) -> bool:
        if len(self) >= REMEMBERED:
            self.clear()
        known = len(self)
        self.add(mark)
        return len(self) > known


def _anchor_counts(rows: DataFrame, window: int) -> DataFrame:
    """gram, n, mixed of the anchors that occur more than once; mixed: with strips that differ."""

    def added(grams: list, wholes: list) -> pa.RecordBatch:
        gram, whole = np.concatenate(grams), np.concatenate(wholes)
        order = np.argsort(gram, kind="stable")
        gram, whole = gram[order], whole[order]
        at = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        columns = [gram[at], np.diff(np.append(at, len(gram))), np.minimum.reduceat(whole, at), np.maximum.reduceat(whole, at)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["gram", "n", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, grams, wholes, total = _Seen(), [], [], 0
        for batch in slices(batches):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if len(text) < window or not seen.new((key, len(text))):
                    continue
                _, _, _, gram, whole = strips(text, window)
                grams.append(gram)
                wholes.append(whole)
                total += len(gram)
                if total >= BLOCK_ANCHORS:
                    yield added(grams, wholes)
                    grams, wholes, total = [], [], 0
        if grams:
            yield added(grams, wholes)

    met = rows.select("key", "size", "text").mapInArrow(run, "gram long, n long, low long, high long")
    counts = met.groupBy("gram").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return counts.where("n > 1").selectExpr("gram", "n", "low <> high AS mixed")


def _shared_strips(rows: DataFrame, window: int, shared: np.ndarray, mixed: np.ndarray) -> DataFrame:
    """Strips whose anchor may occur elsewhere: key, size, first, end, anchor, gram, whole, n, data (the bytes, where
    strips of the anchor may differ, once a task). Strips that a text holds more than once count here (n); what they
    cover comes as rows without gram."""
    sent = share(rows.sparkSession.sparkContext, (shared, mixed))
    kinds = [pa.int64()] * 8 + [pa.binary()]
    names = ["key", "size", "first", "end", "anchor", "gram", "whole", "n", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, differ = kept(sent, lambda x: x)
        seen, strips_seen = _Seen(), _Seen()
        for batch in slices(batches):
            out = [[] for _ in names]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if len(text) < window or not seen.new((key, len(text))):
                    continue
                first, end, anchor, gram, whole = strips(text, window)
                use = np.flatnonzero(holds(many, gram))
                if not len(use):
                    continue
                first, end, anchor, gram, whole = (c[use] for c in (first, end, anchor, gram, whole))
                _, at, back, n = np.unique(np.stack((gram, whole), 1), axis=0, return_index=True, return_inverse=True, return_counts=True)
                again = n[back.ravel()] > 1
                for a, b in zip(*merged(first[again], end[again])):
                    for column, value in zip(out, (key, len(text), int(a), int(b), None, None, None, 0, None)):
                        column.append(value)
                first, end, anchor, gram, whole = (c[at] for c in (first, end, anchor, gram, whole))
                differs = holds(differ, gram).tolist()
                for a, b, c, g, w, k, d in zip(first.tolist(), end.tolist(), anchor.tolist(), gram.tolist(), whole.tolist(), n.tolist(), differs):
                    data = text[a:b] if d and strips_seen.new((g, w)) else None
                    for column, value in zip(out, (key, len(text), a, b, c, g, w, k, data)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    schema = ", ".join(f"{n} {'binary' if n == 'data' else 'long'}" for n in names)
    return rows.select("key", "size", "text").mapInArrow(run, schema)


def _equal_windows(block: list[tuple], window: int) -> Iterator[tuple[int, int, int]]:
    """place in the block, first and last window start of the asked strips that hold repeated windows.

    A strip of the block: group (number), asked, at (its anchor), low and high (offsets from window start to anchor that
    the group covers), data.
    """
    lengths = np.array([len(b[-1]) for b in block])
    base = np.cumsum(lengths) - lengths
    group, at, low, high = (np.array([b[i] for b in block], np.int64) for i in (0, 2, 3, 4))
    begin = at - np.minimum(high, at)
    windows = at - np.maximum(low, at - (lengths - window)) - begin + 1
    strip = np.repeat(np.arange(len(block)), windows)
    start = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(begin, windows)
    rank = group[strip] * (window + 1) + at[strip] - start
    spot = base[strip] + start
    size = -(-window // DIGITS)
    codes = run_hashes(np.frombuffer(b"".join(b[-1] for b in block), np.uint8), size)
    for digit in [*range(0, window - size, size), window - size]:
        code = codes[spot + digit]
        order = np.lexsort((code, rank))
        rank, code, strip, start, spot = rank[order], code[order], strip[order], start[order], spot[order]
        new = np.concatenate(([True], (rank[1:] != rank[:-1]) | (code[1:] != code[:-1]), [True]))[: len(rank) + 1]
        stays = ~(new[:-1] & new[1:])
        rank, strip, start, spot = np.cumsum(new[:-1])[stays], strip[stays], start[stays], spot[stays]
        if not len(rank):
            return
    least, most = np.full(len(block), np.iinfo(np.int64).max), np.full(len(block), -1)
    np.minimum.at(least, strip, start)
    np.maximum.at(most, strip, start)
    for i in np.flatnonzero(most >= 0).tolist():
        if block[i][1]:
            yield i, int(least[i]), int(most[i])


def _sorted_groups(strips_: DataFrame, window: int) -> DataFrame:
    """key, size, start, end that the repeated windows of asked strips cover; groups (core, low) lie in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, places, group, number, windows = [], [], None, -1, 0

        def out() -> pa.RecordBatch:
            spans = [(*places[i][:2], places[i][2] + a, places[i][2] + b + window) for i, a, b in _equal_windows(block, window)]
            columns = list(zip(*spans)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "size", "start", "end"])

        for batch in slices(batches):
            for core, low, high, asked, at, key, size, first, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (core, low) != group:
                    if windows > BLOCK_WINDOWS:
                        yield out()
                        block, places, windows = [], [], 0
                    group, number = (core, low), number + 1
                block.append((number, asked, at, low, high, data))
                places.append((key, size, first))
                windows += len(data) - window + 1
        if block:
            yield out()

    columns = ["core", "low", "high", "asked", "at", "key", "size", "first", "data"]
    met = strips_.select(columns).repartition("core", "low").sortWithinPartitions("core", "low")
    return met.mapInArrow(run, "key long, size long, start long, end long")


def _differing(strips_: DataFrame, window: int) -> DataFrame:
    """key, size, start, end: what repeated windows cover in the asked strips of anchors with several kinds of strip."""
    level = strips_.selectExpr("*", "gram AS core", "0L AS low", f"{window - gram_size(window)}L AS high").drop("gram")
    found = None
    while True:
        hot = staged(level.groupBy("core", "low").count().where(f"count > {GROUP}").drop("count"), "hot")
        more = _sorted_groups(level.join(hot, ["core", "low"], "left_anti"), window)
        found = more if found is None else found.unionAll(more)
        if hot.isEmpty():
            return found
        equal, level = _halved(level.join(hot, ["core", "low"], "left_semi"), window)
        found = found.unionAll(equal)


def _halved(strips_: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """The strips of hot groups with their windows halved by offset: what parts that are equal as a whole cover
    (key, size, start, end), and one strip of each kind of part. A part whose windows all have one offset is of one
    kind with all others of its group."""
    parts = strips_.selectExpr(
        "* EXCEPT (low, high)",
        "inline(CASE WHEN low = high THEN array(struct(low AS low, high AS high)) ELSE"
        " array(struct(low AS low, (low + high) div 2 AS high), struct((low + high) div 2 + 1 AS low, high AS high)) END)",
    )
    parts = parts.where(f"greatest(low, at - length(data) + {window}) <= least(high, at)").selectExpr(
        "* EXCEPT (core)",
        f"xxhash64(core, substring(data, int(at - low + 1), int({window} - high + low))) AS core",
        "least(high, at) AS far",
        f"greatest(low, at - length(data) + {window}) AS near",
    )
    part = f"substring(data, int(at - far + 1), int({window} + far - near))"
    parts = staged(parts.selectExpr("*", f"xxhash64(far, near, {part}) AS kind"), "parts")
    kinds = parts.groupBy("core", "low", "kind").agg(F.count("*").alias("n"), F.min("row").alias("row"))
    kinds = staged(kinds, "part-kinds")
    equal = parts.where("asked").join(kinds.where("n > 1").drop("row"), ["core", "low", "kind"])
    chosen = kinds.selectExpr("core", "low", "kind", "row", "n = 1 AS alone")
    going = parts.where("low < high").join(chosen, ["core", "low", "kind", "row"])
    return (
        equal.selectExpr("key", "size", "first + at - far AS start", f"first + at - near + {window} AS end"),
        staged(going.selectExpr("* EXCEPT (asked, alone, far, near, kind)", "asked AND alone AS asked"), "halves"),
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, removed array<struct<start, end>>, kept (binary) of every row.

    A text is its UTF-8 bytes. A byte goes if it lies in a run of ``window`` bytes that starts in another place too,
    in the same text or another, also where the two overlap; runs are judged on the input. removed: the
    maximal removed spans, ascending; kept: the bytes that stay.

    Null and empty texts have no bytes and lose none; texts shorter than ``window`` lose none. Rows with equal texts,
    repeated ids or not, count as several places, so long copies go altogether. A null id is an id like any
    other. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = rows.select(
        "doc_id",
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
        F.xxhash64(F.col("text").cast("binary")).alias("key"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"),
    )
    counts = staged(_anchor_counts(rows, window), "anchors")
    bits = bit_count(counts.count())
    shared = bitmap(counts.select("gram"), bits)
    mixed = bitmap(counts.where("mixed").select("gram"), bits)
    met = _shared_strips(rows, window, shared, mixed).withColumn("row", F.monotonically_increasing_id())
    met = staged(met, "strips")
    strips_ = met.where("gram IS NOT NULL")
    kinds = strips_.groupBy("gram", "whole").agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("data").isNotNull(), F.col("row"))).alias("row")
    )
    kinds = staged(kinds, "kinds")
    equal = strips_.select("gram", "whole", "key", "size", "first", "end").join(kinds.where("n > 1").select("gram", "whole"), ["gram", "whole"])
    several = kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1")
    chosen = kinds.where("row IS NOT NULL").join(several.select("gram"), "gram").selectExpr("row", "n = 1 AS asked")
    differ = met.where("data IS NOT NULL").join(chosen, "row").selectExpr(
        "row", "gram", "asked", "anchor - first AS at", "key", "size", "first", "data"
    )
    spans = (
        equal.selectExpr("key", "size", "first AS start", "end")
        .unionAll(met.where("gram IS NULL").selectExpr("key", "size", "first AS start", "end"))
        .unionAll(_differing(staged(differ, "differing"), window))
        .unionAll(
            rows.where(F.col("size") >= window).groupBy("key", "size").count().where("count > 1").selectExpr("key", "size", "0L AS start", "size AS end")
        )
    )
    spans = staged(spans.groupBy("key", "size").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    return _cut(marked(rows, F.col("key"), spans.select("key"), "maybe"), spans)


def _cut(rows: DataFrame, spans: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches):
            removed, rest = [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                starts, ends = (np.array([s[n] for s in found or []], np.int64) for n in ("start", "end"))
                starts, ends = (c.tolist() for c in merged(starts, ends))
                removed.append([{"start": a, "end": b} for a, b in zip(starts, ends)])
                rest.append(b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)])))
            sizes = pa.array([len(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(removed, kind), pa.array(rest, pa.binary())],
                ["doc_id", "n_bytes", "removed", "kept"],
            )

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, removed array<{SPAN}>, kept binary"
    plain = rows.where("NOT maybe").selectExpr("doc_id", "size AS n_bytes", f"CAST(array() AS array<{SPAN}>) AS removed", "text AS kept")
    hit = rows.where("maybe").join(spans, ["key", "size"], "left").select("doc_id", "text", "spans")
    return plain.unionAll(hit.mapInArrow(run, schema))
