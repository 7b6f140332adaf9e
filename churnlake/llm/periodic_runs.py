"""Maximal periodic runs of words, by tiles of one scale for each octave of periods.

*Explode.* Periods under eight words are found by comparing the words with themselves, shifted. For the periods from 2^k
up to 2^(k+1) a text is cut into overlapping tiles: tile b has a border at word b, a
multiple of 2^k, and reaches 2^k words back and four times that ahead. A run of four periods q or more holds two to
five neighbouring borders whose next 2^k words all come again q words later; hashes of all blocks of 2^k words tell
which tiles those are, and only they go on. Neighbouring tiles travel as one strip of bounded length, so their overlap
is stored once.

*Solve.* Each tile is solved for itself, whatever task it is in: the Z-function of the words ahead of its border tells for
every period how far the text repeats to the right, that of the words behind it, read backwards, how far to the left.
Fragments that neither reach the tile's edge nor can belong to a run are dropped, as are periods whose root is a power
of a shorter one: the shorter period has the same run in its own octave.

*Stitch.* Fragments meet by document and period, where overlapping ones join to maximal runs. Only texts with tiles are
kept for what follows; all others pass through without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlake.llm.common import by_bytes, pick, slices
from churnlake.llm.fingerprints import words_of
from churnlake.llm.repeated_windows import mix
from churnlake.session import staged

#: The least number of words of a run, and of periods in it.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words of a strip of tiles, next to those of a single tile.
STRIP_WORDS = 1 << 16
#: Shorter periods need no tiles: whole columns of words are compared with themselves, shifted.
TILED = 8
#: What parts words, for each byte value.
WHITE = np.isin(np.arange(256), [32, *range(9, 14)])
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def short_periods(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """(period, first, last): the places i from first up to last where word i equals word i + period, for the runs of
    periods under ``TILED``. And for each place how far the longest such run reaches that holds it."""
    found, known = [], set()
    reach = np.zeros(len(codes), np.int64)
    owner_end = np.repeat(ends, ends - starts)
    for q in range(1, min(TILED, len(codes))):
        same = np.zeros(len(codes) + 2, np.int8)
        same[1 : len(codes) - q + 1] = (codes[:-q] == codes[q:]) & (np.arange(q, len(codes)) < owner_end[:-q])
        edges = np.flatnonzero(np.diff(same))
        first, last = edges[::2], edges[1::2]
        long = last - first >= max(LEAST_WORDS, LEAST_PERIODS * q) - q
        for a, b in zip(first[long].tolist(), last[long].tolist()):
            if (a, b + q) not in known:  # else a shorter period has the same run
                known.add((a, b + q))
                found.append((q, a, b))
                reach[a : b + q] = np.maximum(reach[a : b + q], b + q)
    return found, reach


def open_tiles(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, reach: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(k, borders) of the tiles of periods from ``TILED`` on that may hold a run. The texts lie one behind the other in
    ``codes``; borders are multiples of 2^k within their text. Where the next three blocks of a border lie in a run of
    a short period (``reach``), no longer period can be the smallest of a run."""
    blocks, k = codes, 0
    while len(ends) and 1 << k <= ((ends - starts) // LEAST_PERIODS).max():
        size = 1 << k
        if size < TILED:
            blocks, k = _doubled(blocks, size), k + 1
            continue
        count = np.maximum(0, (ends - starts) // size)
        border = np.repeat(starts - size * (np.cumsum(count) - count), count) + size * np.arange(count.sum())
        end = np.repeat(ends, count)
        inside = border + 2 * size <= end  # the block comes again after 2^k words or more
        inside &= reach[np.minimum(border, len(reach) - 1)] < border + 3 * size
        border, end = border[inside], end[inside]
        periods = np.arange(size, 2 * size)
        needs = (np.maximum(LEAST_WORDS, LEAST_PERIODS * periods) - periods - size + 1) // size
        met, rows, most = np.zeros(len(border), bool), max(8, (1 << 20) // size), int(needs.max())
        for first in range(0, len(border), rows):
            part = slice(first, first + rows + most - 1)
            again = border[part, None] + periods
            same = (blocks[np.minimum(again, len(blocks) - 1)] == blocks[border[part]][:, None]) & (again + size <= end[part, None])
            chain = same
            for length in range(1, most + 1):
                hit = np.flatnonzero(chain[:, needs == length].any(1))
                for step in range(length):
                    met[first + hit + step] = True
                chain = chain[:-1] & same[length:]
        if met.any():
            yield k, border[met]
        blocks, k = _doubled(blocks, size), k + 1


def _doubled(blocks: np.ndarray, size: int) -> np.ndarray:
    """Hashes of blocks of twice the size."""
    return mix(blocks[:-size], blocks[size:]) if len(blocks) > size else blocks[:0]


def z_function(word: list[int]) -> list[int]:
    """For each place, how many elements from there on equal those from the start on."""
    n = len(word)
    z, left, right = [n] + [0] * (n - 1), 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and word[k] == word[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def tile_fragments(words: list[int], border: int, k: int) -> Iterator[tuple[int, int, int]]:
    """period, first, last: the places i from first up to last, around ``border``, where word i equals word i + period,
    as far as the tile tells, for the periods of octave k that may belong to a run."""
    size = 1 << k
    ahead = words[border : border + 4 * size]
    z = z_function(ahead)
    periods = [q for q in range(size, min(2 * size, len(ahead) - size + 1)) if z[q] >= size]
    if not periods:
        return
    behind = words[max(0, border - size) : border][::-1]
    reach = len(behind)
    back = words[max(0, border - size) : border + 2 * size][::-1]  # from border + 2 size - 1 down
    z_back = z_function([*behind, -1, *back])[reach + 1 :]
    top = border + len(words[border : border + 2 * size]) - 1
    for q in periods:
        right, left = min(z[q], 2 * size), z_back[top - (border + q - 1)]
        at_edge = right == 2 * size or left == size
        root = (d for d in range(1, q // 2 + 1) if q % d == 0 and z[d] >= q - d)
        if (at_edge or right + left >= (LEAST_PERIODS - 1) * q) and next(root, None) is None:
            yield q, border - left, border + right


def _texts_with_tiles(rows: DataFrame) -> DataFrame:
    """Rows of two kinds. Texts (octave null): row, doc_id, n_words, text, open (whether it has tiles; else text is the
    final one). Strips of their tiles: row, octave, first (word), borders, words (numbers of a text's words). Runs of short
    periods: row, octave -1, first (the period), borders (the first and last place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2):
            texts = batch.column(2).to_pylist()
            words = [(text or b"").split() for text in texts]
            counts = np.array([len(w) for w in words], np.int64)
            ends = np.cumsum(counts)
            codes = words_of(np.frombuffer(b" ".join(t or b"" for t in texts), np.uint8), WHITE)[2]
            keys, strips, tiled, numbers = batch.column(0).to_pylist(), [], set(), {}
            short, reach = short_periods(codes, ends - counts, ends) if len(codes) else ([], codes)
            for q, a, b in short:
                i = int(np.searchsorted(ends, a, "right"))
                origin = int(ends[i] - counts[i])
                strips.append((keys[i], -1, q, [a - origin, b - origin], []))
                tiled.add(i)
            for k, borders in open_tiles(codes, ends - counts, ends, reach) if len(codes) else ():
                size, owner = 1 << k, np.searchsorted(ends, borders, "right")
                far = max(STRIP_WORDS, 8 * size)
                cut = np.ones(len(borders), bool)
                cut[1:] = (owner[1:] != owner[:-1]) | (np.diff(borders) > size)
                begin = borders[np.maximum.accumulate(np.where(cut, np.arange(len(borders)), 0))]
                cut[1:] |= ((borders - begin) // far)[1:] != ((borders - begin) // far)[:-1]
                for part in np.split(np.arange(len(borders)), np.flatnonzero(cut)[1:]):
                    i = int(owner[part[0]])
                    if i not in numbers:
                        table: dict[bytes, int] = {}
                        numbers[i] = [table.setdefault(w, len(table)) for w in words[i]]
                    origin = int(ends[i] - counts[i])
                    own = borders[part] - origin
                    first = max(0, int(own[0]) - size)
                    strips.append((keys[i], k, first, own.tolist(), numbers[i][first : int(own[-1]) + 4 * size]))
                    tiled.add(i)
            n, m = len(words), len(strips)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys + [s[0] for s in strips], pa.int64()),
                    pa.concat_arrays([batch.column(1), pa.nulls(m, batch.column(1).type)]),
                    pa.array(counts.tolist() + [None] * m, pa.int64()),
                    pa.array([b" ".join(w) for w in words] + [None] * m, pa.binary()),
                    pa.array([i in tiled for i in range(n)] + [None] * m, pa.bool_()),
                    pa.array([None] * n + [s[1] for s in strips], pa.int32()),
                    pa.array([None] * n + [s[2] for s in strips], pa.int64()),
                    pa.array([None] * n + [s[3] for s in strips], pa.list_(pa.int64())),
                    pa.array([None] * n + [s[4] for s in strips], pa.list_(pa.int32())),
                ],
                ["row", "doc_id", "n_words", "text", "open", "octave", "first", "borders", "words"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"row long, doc_id {kind}, n_words long, text binary, open boolean, octave int, first long, borders array<long>, words array<int>",
    )


def _fragments(strips: DataFrame) -> DataFrame:
    """row, period, start, end of the words that a tile shows to be periodic; those of one strip are joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            out = []
            for row, k, first, borders, words in zip(*(c.to_pylist() for c in batch.columns)):
                last: dict[int, list[int]] = {}
                if k < 0:
                    out.append((row, first, *borders))
                    continue
                for border in borders:
                    for q, a, b in tile_fragments(words, border - first, k):
                        if q in last and a + first <= last[q][1]:
                            last[q][1] = max(last[q][1], b + first)
                        else:
                            if q in last:
                                out.append((row, q, *last[q]))
                            last[q] = [a + first, b + first]
                out.extend((row, q, *ab) for q, ab in last.items())
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "period", "start", "end"])

    strips = strips.select("row", "octave", "first", "borders", "words").repartition("row", "octave", "first")
    return strips.mapInArrow(run, "row long, period long, start long, end long")


def _stitched(fragments: DataFrame) -> DataFrame:
    """row, runs: overlapping or adjoining fragments of a document and period as maximal runs, by start, then period."""
    before = Window.partitionBy("row", "period").orderBy("start", "end")
    reach = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))
    numbered = fragments.withColumn("opens", opens).withColumn("part", F.sum("opens").over(before))
    runs = numbered.groupBy("row", "period", "part").agg(F.min("start").alias("start"), F.expr("max(end) + period - min(start)").alias("length"))
    runs = runs.where(f"length >= greatest({LEAST_WORDS}, {LEAST_PERIODS} * period)")
    listed = runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("r"))
    return listed.selectExpr("row", "transform(r, x -> struct(x.start, x.length, x.period)) AS runs")


def _collapsed(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = []
            for text, runs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = text.split(b" ")
                edges = np.zeros(len(words) + 1, np.int64)
                for r in runs:
                    edges[r["start"] + r["period"]] += 1
                    edges[r["start"] + r["length"]] -= 1
                stays = np.cumsum(edges)[:-1] == 0
                texts.append(b" ".join(w for w, s in zip(words, stays.tolist()) if s))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], batch.column(3), pa.array(texts, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"]
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed binary")


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs array<struct<start, length, period>>, collapsed (binary) of every row.

    Words are runs without ASCII white space, numbered from 0. A run: a stretch of words with smallest period q
    (words q apart are equal) of ``LEAST_WORDS`` words and ``LEAST_PERIODS`` periods at least that cannot be extended;
    runs are ordered by start, then period. collapsed: the words, joined by one space, without those that
    some run contains after its first q words.

    Null and empty texts have no words and no runs. Each row is looked at for itself, so rows that repeat an id or a
    text have equal results. A null id is an id like any other. An empty table gives no rows. Other columns are ignored.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("binary").alias("text"))
    met = _texts_with_tiles(rows)
    plain = met.where("NOT open").selectExpr("doc_id", "n_words", f"CAST(array() AS {RUNS}) AS runs", "text AS collapsed")
    tiled = staged(met.where("open OR octave IS NOT NULL"), "tiles")
    runs = _stitched(_fragments(tiled.where("octave IS NOT NULL")))
    texts = tiled.where("open").select("row", "doc_id", "n_words", "text").join(runs, "row", "left")
    return plain.unionAll(_collapsed(texts.select("doc_id", "n_words", "text", F.coalesce("runs", F.expr(f"CAST(array() AS {RUNS})")).alias("runs"))))
