"""Phrases whose words occur together more often than apart, from Rabin-Karp fingerprints.

*Count.* Prefix polynomials over the codes of words give a fingerprint of every run of n words, for n from 1 up. A task
adds up equal fingerprints before it passes them on, with the key of a text in which they occur; the shuffle sums them. A
run of n words takes part only if both its runs of n - 1 words may be frequent: a bitmap of bounded size, which never
misses one, tells so. Where the bitmap is too small for the data it lets more runs pass, and the counts stay the same.

*Verify.* A second polynomial over other codes travels along. Where it differs for equal fingerprints, different runs
have met: these are counted again by their text.

*Materialise.* Only fingerprints that are frequent become text, read from one text in which they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlake.llm.bitmaps import bit_count, bitmap, holds, marked
from churnlake.llm.common import by_bytes, kept, pick, share
from churnlake.llm.fingerprints import prefix_polynomial, run_codes, words_of
from churnlake.llm.repeated_windows import BYTE_CODES, mix
from churnlake.session import staged

#: Runs of words that a task adds up before it passes them on.
BLOCK_RUNS = 2_000_000
#: Parts of a language's phrases that are ranked by themselves before the best of all parts are.
SHARES = 64
#: For each byte value: the lower-cased byte; whether it parts words; whether it also ends a piece.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
BREAKS = np.isin(np.arange(256), [*b".,;:!?", *range(10, 14)])
PARTS = BREAKS | np.isin(np.arange(256), [9, 32])
#: Bits of a fingerprint; tests take fewer.
BITS = 64


class _Texts:
    """The words of some texts, with their pieces, fingerprints and languages."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        joined = b"\n".join(texts)
        self.data = LOWER[np.frombuffer(joined, np.uint8)]
        self.first, self.end, codes = words_of(self.data, PARTS)
        other = run_codes(prefix_polynomial(mix(BYTE_CODES, BYTE_CODES[::-1])[self.data]), self.first, self.end)
        self.piece = np.concatenate(([0], np.cumsum(BREAKS[self.data])))[self.first]
        sizes = np.array([len(t) + 1 for t in texts])
        self.owner = np.searchsorted(np.cumsum(sizes), self.first, "right")
        self.lang = np.array([xxhash.xxh3_64_intdigest(x) for x in langs], np.uint64)[self.owner]
        self.prefix, self.other = prefix_polynomial(codes), prefix_polynomial(mix(other, codes))

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """start, fingerprint of the runs of ``n`` words inside pieces."""
        start = np.flatnonzero(self.piece[: max(0, len(self.piece) - n + 1)] == self.piece[n - 1 :])
        code = mix(run_codes(self.prefix, start, start + n), self.lang[start])
        return start, code & np.uint64(2**BITS - 1)

    def checks(self, start: np.ndarray, n: int) -> np.ndarray:
        return mix(run_codes(self.other, start, start + n), self.lang[start])

    def frequent_runs(self, n: int, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Runs whose two shorter runs are in the bitmap ``below``."""
        start, code = self.runs(n)
        if below is None or not len(start):
            return start, code
        parts, codes = self.runs(n - 1)
        good = np.zeros(len(self.piece) + 1, bool)
        good[parts] = holds(below, codes)
        stays = good[start] & good[start + 1]
        return start[stays], code[stays]

    def phrase(self, start: int, n: int) -> str:
        words = zip(self.first[start : start + n].tolist(), self.end[start : start + n].tolist())
        return " ".join(self.data[a:b].tobytes().decode("utf-8", "replace") for a, b in words)


def _added_up(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Sums of the runs in ``held``, which is emptied."""
    codes, keys, checks = (np.concatenate(c) for c in zip(*held))
    held.clear()
    order = np.argsort(codes, kind="stable")
    codes, keys, checks = codes[order], keys[order], checks[order]
    new = codes[1:] != codes[:-1]
    if (~new & (checks[1:] != checks[:-1])).any():
        order = np.lexsort((checks, codes))
        codes, keys, checks = codes[order], keys[order], checks[order]
        new = (codes[1:] != codes[:-1]) | (checks[1:] != checks[:-1])
    at = np.flatnonzero(np.concatenate(([True], new)))
    columns = [codes[at].view(np.int64), np.diff(np.append(at, len(codes))), keys[at], checks[at].view(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["code", "n", "key", "check"])


def _counts(rows: DataFrame, n: int, least: int, below: np.ndarray | None) -> DataFrame:
    """code, n, key, low, high of the runs of ``n`` words that may occur ``least`` times."""
    sent = share(rows.sparkSession.sparkContext, below)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = kept(sent, lambda x: x)
        held, total = [], 0
        for batch in by_bytes(batches, 2):
            texts = _Texts(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            start, code = texts.frequent_runs(n, bits)
            if len(start):
                held.append((code, batch.column(0).to_numpy()[texts.owner[start]], texts.checks(start, n)))
                total += len(start)
            if total > BLOCK_RUNS:
                yield _added_up(held)
                total = 0
        if held:
            yield _added_up(held)

    met = rows.select("key", "lang", "text").mapInArrow(run, "code long, n long, key long, check long").repartition("code")
    sums = met.groupBy("code").agg(F.sum("n").alias("n"), F.min("key").alias("key"), F.min("check").alias("low"), F.max("check").alias("high"))
    return sums.where(F.col("n") >= least)


def _phrases_at(rows: DataFrame, longest: int) -> DataFrame:
    """code, lang, words, phrase of the codes (``codes``) that each row asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            langs, asked = batch.column(0).to_pylist(), batch.column(2)
            texts = _Texts(langs, batch.column(1).to_pylist())
            wanted = np.unique(asked.flatten().to_numpy().view(np.uint64))
            out = []
            for n in range(1, longest + 1):
                start, code = texts.runs(n)
                code, at = np.unique(code, return_index=True)
                met = np.isin(code, wanted, assume_unique=True)
                for c, i in zip(code[met].view(np.int64).tolist(), start[at[met]].tolist()):
                    out.append((c, langs[texts.owner[i]], n, texts.phrase(i, n)))
            yield _named(out)

    return rows.select("lang", "text", "codes").mapInArrow(run, "code long, lang string, words long, phrase string")


def _named(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    columns = list(zip(*out)) if out else [[]] * 4
    names = ["code", "lang", "words", "phrase", "n"][: len(columns)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _counted_by_text(rows: DataFrame, codes: DataFrame, longest: int, least: int) -> DataFrame:
    """lang, words, phrase, n of the runs whose fingerprints are among ``codes``, counted by what they say."""
    sent = share(rows.sparkSession.sparkContext, bitmap(codes, bit_count(codes.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = kept(sent, lambda x: x)
        for batch in by_bytes(batches, 2):
            langs, met = batch.column(1).to_pylist(), {}
            texts = _Texts(langs, batch.column(2).to_pylist())
            for n in range(1, longest + 1):
                start, code = texts.runs(n)
                hit = holds(bits, code)
                for i, c in zip(start[hit].tolist(), code[hit].view(np.int64).tolist()):
                    place = (c, langs[texts.owner[i]], n, texts.phrase(i, n))
                    met[place] = met.get(place, 0) + 1
            if met:
                yield _named([(*place, k) for place, k in met.items()])

    met = rows.select("key", "lang", "text").mapInArrow(run, "code long, lang string, words long, phrase string, n long")
    met = met.join(codes, "code").groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return met.where(F.col("n") >= least)


def frequent_phrases(rows: DataFrame, longest: int, least: int) -> DataFrame:
    """lang, words, phrase, n of all runs of 1 to ``longest`` words inside pieces that occur ``least`` times or more in
    a language; ``rows`` have key, lang, text."""
    below, found = None, []
    for n in range(1, longest + 1):
        counts = staged(_counts(rows, n, least, below).withColumn("words", F.lit(n).cast("long")), f"runs-{n}")
        found.append(counts)
        below = bitmap(counts.select("code"), bit_count(counts.count()))
    found = reduce(DataFrame.unionAll, found)
    sure = found.where("low = high")
    asked = staged(sure.groupBy("key").agg(F.collect_list("code").alias("codes")), "asked")
    holders = marked(rows, F.col("key"), asked.select("key"), "maybe").where("maybe").join(asked, "key")
    named = _phrases_at(holders, longest).groupBy("code", "words").agg(F.min(F.struct("lang", "phrase")).alias("p"))
    phrases = sure.select("code", "words", "n").join(named, ["code", "words"]).select("p.lang", "words", "p.phrase", "n")
    mixed = staged(found.where("low <> high").select("code").distinct(), "mixed")
    if not mixed.isEmpty():
        again = _counted_by_text(rows, mixed, longest, least)
        phrases = phrases.unionAll(again.select("lang", "words", "phrase", "n"))
    return staged(phrases, "phrases")


def word_totals(rows: DataFrame) -> DataFrame:
    """lang, n: all word occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, int] = {}
        for batch in by_bytes(batches, 1):
            langs = batch.column(0).to_pylist()
            data = np.frombuffer(b"\n".join(batch.column(1).to_pylist()), np.uint8)
            inside = np.concatenate(([False], ~PARTS[data]))
            begins = np.concatenate(([0], np.cumsum(inside[1:] & ~inside[:-1])))
            ends = np.cumsum([len(t) + 1 for t in batch.column(1).to_pylist()])
            counts = np.diff(begins[np.concatenate(([0], np.minimum(ends, len(data))))])
            for lang, n in zip(langs, counts.tolist()):
                totals[lang] = totals.get(lang, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], ["lang", "n"])

    return rows.select("lang", "text").mapInArrow(run, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(
    docs: DataFrame,
    longest: int = 3,
    least: int = 10,
    top: int = 2000,
    inside_percent: int = 50,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    A-Z is lower-cased; texts fall into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs. n: the
    words of a language; f: the occurrences of a phrase inside pieces, overlaps included. Candidates are phrases of 2 to
    ``longest`` words with a = f >= ``least``. The cut after the first k words that gives the lowest
    score = floor(1,000,000 a a / (l r)), l and r being f of both sides, counts; of equal scores the smallest k. A
    candidate goes if a longer candidate holds its words and 100 f(longer) >= ``inside_percent`` * a. Order: score and a
    descending, then the phrase by its bytes. The arithmetic is exact for counts below 10^15.

    Null and empty texts have no words; a null language is ``und``. Rows with equal texts count each. Languages
    without candidates have no rows, nor has an empty table. Other columns are ignored.
    """
    rows = pick(docs, lang=lang_col, text=text_col)
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    lang = F.coalesce(F.col("lang"), F.lit("und"))
    rows = rows.select(F.xxhash64(lang, text).alias("key"), lang.alias("lang"), text.alias("text"))
    phrases = frequent_phrases(rows, longest, least)
    candidates = phrases.where("words > 1").selectExpr("lang", "phrase", "n AS a", "split(phrase, ' ') AS w")
    cuts = candidates.selectExpr("*", "explode(sequence(1, size(w) - 1)) AS k").selectExpr(
        "lang", "phrase", "a", "k", "array_join(slice(w, 1, k), ' ') AS left", "array_join(slice(w, k + 1, size(w)), ' ') AS right"
    )
    cuts = cuts.join(phrases.selectExpr("lang", "phrase AS left", "n AS l"), ["lang", "left"])
    cuts = cuts.join(phrases.selectExpr("lang", "phrase AS right", "n AS r"), ["lang", "right"])
    big = "CAST({} AS decimal(15, 0))"
    score = f"(1000000 * {big.format('a')} * {big.format('a')}) div ({big.format('l')} * {big.format('r')})"
    best = cuts.selectExpr("lang", "phrase", "a", f"struct({score} AS score, k, l, r) AS cut").groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    inner = candidates.where("size(w) > 2").selectExpr("lang", "a", "w", "explode(sequence(2, size(w) - 1)) AS k")
    inner = inner.selectExpr("lang", "a", "w", "k", "explode(sequence(1, size(w) - k + 1)) AS i")
    inner = inner.selectExpr("lang", "array_join(slice(w, i, k), ' ') AS phrase", "a AS longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    stays = best.join(inner, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {inside_percent} * a")
    order = (F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    stays = stays.withColumn("share", F.expr(f"pmod(xxhash64(phrase), {SHARES})"))  # no language meets whole in one task
    first = F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))
    ranked = stays.withColumn("rank", first).where(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    ranked = ranked.where(F.col("rank") <= top)
    listed = ranked.selectExpr("lang", "rank", "phrase", "a", "cut.l", "cut.r", "cut.score")
    return listed.join(word_totals(rows), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
