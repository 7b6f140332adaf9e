"""Exact Jaccard join of documents over word n-grams, with set-relation skipping.

A document's set holds hashes of its distinct n-grams, in the order of the hashes. Sets of like size are cut at the
same hashes into more parts than two linked sets can have differences, so linked sets agree in at least one
whole part. The index lists hold the sets with an equal part; a list of single n-grams would grow with the
square of a corpus whose words are few, a list of parts holds sets that have several n-grams in common.

*Answers from similar sets.* Equal sets of a task enter the lists once. In each list the sets are compared with
one leader; sets that link are one component from then on, and a set that equals its leader leaves its list entries to
it. Lists that still hold several components are contracted in ``ROUNDS`` further rounds: each list draws a leader by a
hash of that round, and a set is compared with the leader that is nearest by its sketch.

*Sketches.* A sketch holds, for each of ``SKETCH_BITS`` buckets of hashes, whether the set has an odd number of n-grams there.
An n-gram that only one of two sets has flips one bit, so two sketches never differ in more bits than their sets differ in
n-grams: pairs whose sketches are too far apart for a link are skipped without their texts, and no link is lost. Long sets
fill their sketches up, which then skip less.

*Skipping in the lists.* The remaining lists are cut into blocks by position: the n-grams that a set has before the part.
A block carries the positions, sizes and components of its entries. Two sets differ at least by the distance of
their positions, and of what follows the part; an entry skips a block of its own component, of sizes out of
ratio or of positions too far, and an entry of a block whose sketch is too far; only what is left is enumerated. Linked sets
agree in all parts but as many as they have differences, so a pair is compared only if it shares that many lists of a size class.

Sets that are known to be connected are never compared again, so a group of thousands of near copies costs a few
comparisons for each member.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlake.llm.bitmaps import marked
from churnlake.llm.common import pick, slices
from churnlake.llm.components import components
from churnlake.session import staged

NGRAM, PERCENT = 4, 85
ROUNDS = 2
HOT_SHARE, LOCAL = 1e-4, 4
BLOCK_ENTRIES = 1_000_000
BITMAP_BITS = 1 << 25
PART_PAIRS = 500
BLOCK_PLACES = 32
SKETCH_BITS = 512
SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]
CACHE_WORDS = 100_000
MIX = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
CLASS_MASK = np.uint64(63)  # the last bits of a key tell size classes that lie side by side apart


class WordHashes(dict):
    """64-bit hashes of words; keeps those it has met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def ngram_hashes(text: bytes | None, known: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct hashes (unsigned) of the n-grams of a text; of the whole sequence if it is shorter."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    coded = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    total = np.full(len(words) - width + 1, width * MIX & MASK, np.uint64)
    for i in range(width):
        total += coded[i : len(coded) - width + 1 + i] * np.uint64((2 * i + 1) * MIX & MASK | 1)
        total ^= total >> np.uint64(29)
        total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    return np.unique(total)


def sketch(own: np.ndarray) -> np.ndarray:
    """The parity of the number of hashes in each bucket, as 64-bit words."""
    odd = np.bincount((own & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix_size(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1  # n - ceil(t n) + 1


class Parts:
    """How sets are cut. A class holds sizes whose ratio may link; a set is cut once for each class that the
    smaller set of a link can be in."""

    def __init__(self, percent: int):
        self.percent, self.highs = percent, [1]

    def classes(self, n: int) -> list[tuple[int, int, int]]:
        """(class, parts, spare) for a set of n. Linked sets differ in fewer than parts - spare n-grams."""
        while self.highs[-1] < n:
            low = self.highs[-1] + 1
            self.highs.append(100 * low // self.percent)
        found = []
        for number in range(bisect_left(self.highs, -(-self.percent * n // 100)), bisect_left(self.highs, n) + 1):
            least = self.least(number)
            spare = 1 + least // 16 if least > 1 else 0
            found.append((number, least + spare, spare))
        return found

    def least(self, number: int) -> int:
        """One more than the differences of linked sets whose smaller one is in the class."""
        return prefix_size(100 * self.highs[number] // self.percent, self.percent)

    def cut(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the parts of a set, and the n-grams before each. Empty parts count only in sets that have
        more of them than spare parts: two linked sets agree in more parts than there are spare ones."""
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own)))
        keys, places = [], []
        for number, parts, spare in self.classes(len(own)):
            part = ((own >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            bounds = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
            first, last = bounds[:-1], bounds[1:]
            key = sums[last] - sums[first] + np.arange(1, parts + 1, dtype=np.uint64) * np.uint64(MIX)
            key += np.uint64((number + 1) * 0xD6E8FEB86659FD93 & MASK)
            key ^= key >> np.uint64(32)
            key *= np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(29)
            key = key & ~CLASS_MASK | np.uint64(number) & CLASS_MASK
            full = last > first
            if parts - full.sum() > spare:
                full[:] = True
            keys.append(key[full])
            places.append(first[full])
        return np.concatenate(keys).view(np.int64), np.concatenate(places).astype(np.int64)


def _entries(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Rows of two kinds. Documents (token null): doc, n, copy_of (a document of the same task with an equal
    set), and the sketch of a set that is no copy. List entries: token, doc, n, place (n-grams before the part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first, parts = WordHashes(), {}, Parts(percent)
        for batch in slices(batches):
            docs, sizes, copies, out = [], [], [], []
            sketches, sketched = np.zeros((batch.num_rows, len(SKETCH)), np.int64), np.zeros(batch.num_rows, bool)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = ngram_hashes(text, known, size)
                n, copy = len(own), None
                docs.append(doc)
                sizes.append(n)
                if doc is not None and n:
                    mark = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                    copy = first.setdefault(mark, doc)
                    if copy == doc:
                        sketches[len(docs) - 1], sketched[len(docs) - 1] = sketch(own), True
                        out.append((doc, n, *parts.cut(own)))
                copies.append(copy)
            lengths = [len(tokens) for _, _, tokens, _ in out]
            tokens, places = (np.concatenate([o[i] for o in out] or [np.zeros(0, np.int64)]) for i in (2, 3))
            owners, n = (np.repeat(np.array([o[i] for o in out], np.int64), lengths) for i in (0, 1))
            none = len(docs)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(tokens)]),
                    pa.concat_arrays([pa.array(docs, pa.int64()), pa.array(owners)]),
                    pa.concat_arrays([pa.array(sizes, pa.int64()), pa.array(n)]),
                    pa.concat_arrays([pa.array(copies, pa.int64()), pa.nulls(len(tokens), pa.int64())]),
                    pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(places)]),
                    *[pa.concat_arrays([pa.array(c, mask=~sketched), pa.nulls(len(tokens), pa.int64())]) for c in sketches.T],
                ],
                ["token", "doc", "n", "copy_of", "place", *SKETCH],
            )

    schema = "token long, doc long, n long, copy_of long, place long, "
    return rows.mapInArrow(run, schema + ", ".join(f"{c} long" for c in SKETCH))


def _sketches(known: DataFrame) -> DataFrame:
    """doc, n (the largest), sketch of each document that has list entries. Of an id with several texts only those words
    are told that all of them have in common, the others are null."""
    same = [F.when(F.min(c) == F.max(c), F.min(c)).alias(c) for c in SKETCH]
    return known.where("copy_of = doc").groupBy("doc").agg(F.max("n").alias("n"), *same)


def _flips(x: str, y: str) -> str:
    """In how many n-grams the sets x and y differ at least."""
    return "(" + " + ".join(f"coalesce(bit_count({x}.{c} ^ {y}.{c}), 0)" for c in SKETCH) + ")"


def _near(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose sketches leave a link possible, with ``flips``."""
    met = pairs.join(sketches.alias("x"), F.expr("a = x.doc")).join(sketches.alias("y"), F.expr("b = y.doc"))
    met = met.selectExpr("a", "b", "x.n + y.n AS sizes", f"{_flips('x', 'y')} AS flips")
    return met.where(f"{100 + percent}L * flips <= {100 - percent}L * sizes").select("a", "b", "flips")


def _hot_keys(entries: DataFrame) -> list[int]:
    """Keys that hold more than ``HOT_SHARE`` of all entries; at most 1 / ``HOT_SHARE``. A key with twice that share
    is always among them, or else no block of entries holds it ``LOCAL`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def out() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= max(LOCAL, HOT_SHARE * total)
            return pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(keys[often])]),
                    pa.concat_arrays([pa.array([total], pa.int64()), pa.array(counts[often], pa.int64())]),
                ],
                ["token", "k"],
            )

        for batch in batches:
            held.append(batch.column(0).to_numpy())
            total += batch.num_rows
            if total >= BLOCK_ENTRIES:
                yield out()
                held, total = [], 0
        if held:
            yield out()

    counted = staged(entries.select("token").mapInArrow(run, "token long, k long").groupBy("token").agg(F.sum("k").alias("k")), "key-counts")
    total = counted.where("token IS NULL").first()
    if total is None:
        return []
    return [r["token"] for r in counted.where(F.col("token").isNotNull() & (F.col("k") > HOT_SHARE * total["k"])).collect()]


def _lists(entries: DataFrame) -> DataFrame:
    """Entries of lists with two sets or more, each with the leader of its list.

    Lists meet in one window. Hot keys may hold a third of all sets: their leaders are reduced before a shuffle
    and sent to the entries.
    """
    columns = ["token", "doc", "n", "place", "leader"]
    hot = entries.sparkSession.createDataFrame([(token,) for token in _hot_keys(entries)], "token long")
    packed = entries.selectExpr("token", "doc", "n * 4294967296L + place AS sizes")  # narrow rows to shuffle
    unpacked = ["token", "doc", "sizes div 4294967296L AS n", "sizes % 4294967296L AS place", "leader"]
    whole = Window.partitionBy("token")
    rare = packed.join(F.broadcast(hot), "token", "left_anti")  # bounded by 1 / HOT_SHARE keys
    rare = rare.withColumn("sets", F.count("*").over(whole)).withColumn("leader", F.min("doc").over(whole)).where("sets > 1")
    often = packed.join(F.broadcast(hot), "token", "left_semi")
    leaders = often.groupBy("token").agg(F.min("doc").alias("leader"), F.count("*").alias("sets")).where("sets > 1")
    often = often.join(F.broadcast(leaders), "token")
    return rare.selectExpr(*unpacked).unionByName(often.selectExpr(*unpacked)).select(columns)


class _Verifier:
    """Overlaps of pairs of documents, from the whole texts of those that take part.

    A pair is looked at where the text of its first document, the hub, is: a part holds the set of one hub, and
    its partners stream past. Texts travel once for each pair they partner and once for each part of a hub;
    hubs with many partners are cut into parts of ``PART_PAIRS``. A bitmap of fixed size, by hash of the id, keeps
    most texts that take part in no pair from being shuffled; what passes it by chance meets the join.
    """

    def __init__(self, rows: DataFrame, size: int, percent: int):
        self.rows, self.size, self.percent = rows, size, percent

    def _candidates(self, ids: DataFrame) -> DataFrame:
        spot = f"pmod(xxhash64(doc), {BITMAP_BITS}L)"
        words = ids.selectExpr(f"{spot} div 64 AS word", f"shiftleft(1L, int({spot} % 64)) AS bit")
        bitmap = np.zeros(BITMAP_BITS // 64, np.int64)
        for row in words.groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).collect():
            bitmap[row["word"]] = row["bits"]
        shared = self.rows.sparkSession.sparkContext.broadcast(bitmap)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spots = batch.column(2).to_numpy()
                met = shared.value[spots // 64] >> (spots % 64) & 1
                yield pa.RecordBatch.from_arrays(batch.columns[:2], ["doc", "text"]).filter(pa.array(met == 1))

        rows = self.rows.where("doc IS NOT NULL").selectExpr("doc", "text", f"{spot} AS spot")
        return rows.mapInArrow(run, "doc long, text binary")

    def overlaps(self, pairs: DataFrame) -> DataFrame:
        """a, b, n_a, n_b, shared, linked for each distinct pair (a, b); a is the hub."""
        pairs = staged(pairs, "pairs")
        parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART_PAIRS).cast("int").alias("parts"))
        hubs = parts.selectExpr("a AS doc", "a", "explode(sequence(0, parts - 1)) AS part", "0 AS kind")
        partners = pairs.join(parts, "a").selectExpr("b AS doc", "a", "cast(pmod(xxhash64(b), parts) AS int) AS part", "1 AS kind")
        wanted = staged(hubs.unionByName(partners), "wanted")
        size, percent = self.size, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, key, hubs_here = WordHashes(), None, []
            for batch in slices(batches):
                out = []
                for doc, text, a, part, kind in zip(*(c.to_pylist() for c in batch.columns)):
                    own = ngram_hashes(text, known, size)
                    if (a, part) != key:
                        key, hubs_here = (a, part), []
                    if kind == 0:
                        hubs_here.append(own)
                        continue
                    for hub in hubs_here:
                        shared = len(np.intersect1d(hub, own, assume_unique=True))
                        union = len(hub) + len(own) - shared
                        out.append((a, doc, len(hub), len(own), shared, union > 0 and 100 * shared >= percent * union))
                columns = list(zip(*out)) if out else [[]] * 6
                kinds = [pa.int64()] * 5 + [pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], ["a", "b", "n_a", "n_b", "shared", "linked"]
                )

        texts = self._candidates(wanted.select("doc")).join(wanted, "doc").select("doc", "text", "a", "part", "kind")
        met = texts.repartition("a", "part").sortWithinPartitions("a", "part", "kind")
        return staged(met.mapInArrow(run, "a long, b long, n_a long, n_b long, shared long, linked boolean"), "overlaps")


def _mixed(lists: DataFrame) -> DataFrame:
    """Lists that hold more than one component."""
    mixed = lists.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    return staged(lists.join(mixed.select("token"), "token"), "open-lists")


def _open_lists(lists: DataFrame, clusters: DataFrame) -> DataFrame:
    """token, cluster, component, low and high (sizes), first and last (positions)."""
    joined = lists.join(clusters, "doc", "left").selectExpr(
        "token", "coalesce(leader_of, doc) AS cluster", "coalesce(component, doc) AS component", "n", "place"
    )
    collapsed = joined.groupBy("token", "cluster", "component").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("place").alias("first"), F.max("place").alias("last")
    )
    return _mixed(staged(collapsed, "collapsed"))


def _fits(percent: int, x: str, y: str) -> str:
    """Whether entries x and y can hold linked sets. Linked sets of a and b n-grams differ in at most
    (100 - percent) / (100 + percent) * (a + b)."""
    apart = f"greatest(0L, {x}.first - {y}.last, {y}.first - {x}.last)"
    return (
        f"100L * {x}.high >= {percent}L * {y}.low AND 100L * {y}.high >= {percent}L * {x}.low"
        f" AND {100 + percent}L * {apart} <= {100 - percent}L * ({x}.high + {y}.high)"
    )


def _enough(met: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs of ``met`` that share as many lists of one size class as linked sets must.

    met: a row for each list that a and b share, with the range of their sizes (low_a, high_a, low_b, high_b). Sets that
    differ in d n-grams differ in d parts at most, and at most the spare parts are equal but not listed; so linked
    sets share at least (``Parts.least`` of the class of the smaller one) - d lists of that class.
    """
    parts = Parts(percent)
    parts.classes(1 << 40)
    highs = ",".join(f"{high}L" for high in parts.highs)
    leasts = ",".join(f"{parts.least(i)}L" for i in range(len(parts.highs)))
    shared = met.groupBy("a", "b", F.expr(f"token & {int(CLASS_MASK)}L").alias("class")).agg(
        F.count("*").alias("lists"), F.expr("min(least(low_a, low_b))").alias("low"), F.expr("max(high_a + high_b)").alias("sizes")
    )
    least = f"element_at(array({leasts}), size(filter(array({highs}), h -> h < low)) + 1)"
    return shared.where(f"lists >= {least} - {100 - percent}L * sizes div {100 + percent}L").select("a", "b").distinct()


_RANGES = "x.token AS token", "x.low AS low_a", "x.high AS high_a", "y.low AS low_b", "y.high AS high_b"


def _star_pairs(open_lists: DataFrame, sketches: DataFrame, percent: int, number: int) -> DataFrame:
    """a, b: each cluster b with the nearest leader a of another component. Each round draws other leaders, so a group whose
    members link with few of the others is not left to one of them."""
    drawn = F.struct(F.xxhash64(F.lit(number), "token", "cluster").alias("h"), "component", "cluster", "low", "high", "first", "last")
    leaders = open_lists.groupBy("token").agg(F.min(drawn).alias("s")).select("token", "s.*")
    met = open_lists.alias("y").join(
        leaders.alias("x"), F.expr(f"x.token = y.token AND x.component <> y.component AND {_fits(percent, 'x', 'y')}")
    )
    near = _near(met.selectExpr("x.cluster AS a", "y.cluster AS b").distinct(), sketches, percent)
    best = near.groupBy("b").agg(F.min(F.struct("flips", "a")).alias("s"))
    return best.selectExpr("s.a AS a", "b")


def _contracted(open_lists: DataFrame, linked: DataFrame) -> DataFrame:
    """The lists that are still open once the components of linked clusters are one."""
    of = staged(open_lists.select("cluster", "component").distinct(), "cluster-components")
    a, b = (of.selectExpr(f"cluster AS {x}", f"component AS {y}") for x, y in (("a", "u"), ("b", "v")))
    joined = components(linked.join(a, "a").join(b, "b").selectExpr("u AS a", "v AS b"))
    moved = open_lists.join(joined.selectExpr("node AS component", "component AS whole"), "component", "left")
    columns = ["token", "cluster", "coalesce(whole, component) AS component", "low", "high", "first", "last"]
    return _mixed(staged(moved.selectExpr(*columns), "contracted"))


def _cluster_pairs(open_lists: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """a, b: clusters of different components whose sketches are near and that share enough lists, after skipping blocks."""
    open_lists = open_lists.join(sketches.withColumnRenamed("doc", "cluster").drop("n"), "cluster")
    open_lists = open_lists.withColumn("block", F.expr(f"first div {BLOCK_PLACES}"))
    blocks = open_lists.groupBy("token", "block").agg(
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.max("component").alias("most"),
    )
    probes = open_lists.alias("x").join(
        blocks.alias("k"), F.expr(f"x.token = k.token AND x.component < k.most AND {_fits(percent, 'x', 'k')}")
    )
    probes = probes.selectExpr("x.*", "k.block AS other_block")
    met = probes.alias("x").join(
        open_lists.alias("y"),
        F.expr(
            f"x.token = y.token AND x.other_block = y.block AND x.component < y.component AND {_fits(percent, 'x', 'y')}"
            f" AND {100 + percent}L * {_flips('x', 'y')} <= {100 - percent}L * (x.high + y.high)"
        ),
    )
    return _enough(met.selectExpr("x.cluster AS a", "y.cluster AS b", *_RANGES), percent)


def jaccard_components(
    docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    A-Z is lower-cased and words are runs without ASCII white space. A row's set: the distinct runs of
    ``ngram`` words; with fewer words the whole sequence. Two rows link when
    100 * |intersection| >= ``percent`` * |union|; component_id: the smallest id that links reach.

    Null and empty texts have an empty set and link with nothing. Rows without id link with nothing and
    have no component_id. Rows that repeat an id are one node: their links join. An empty table gives no
    rows. Other columns are ignored.
    """
    rows = pick(docs, doc=id_col, text=text_col)
    rows = rows.select(rows.doc.cast("long").alias("doc"), rows.text.cast("binary").alias("text"))
    entries = staged(_entries(rows, ngram, percent), "entries")
    known = entries.where("token IS NULL")
    copies = known.where("copy_of <> doc").selectExpr("doc AS a", "copy_of AS b")
    lists = staged(_lists(entries.where("token IS NOT NULL")), "lists")
    verifier = _Verifier(rows, ngram, percent)

    sketches = staged(_sketches(known), "sketches")

    # Each set and the leader with which it shares most lists.
    stars = lists.where("leader <> doc").groupBy("doc", "leader").count()
    best = stars.groupBy("doc").agg(F.max(F.struct("count", (-F.col("leader")).alias("m"))).alias("s"))
    compared = verifier.overlaps(_near(best.selectExpr("-s.m AS a", "doc AS b"), sketches, percent).select("a", "b"))
    links = staged(copies.unionAll(compared.where("linked").select("a", "b")), "links")
    # A set that equals its leader leaves its entries to it; an id with several texts keeps its own.
    led = compared.groupBy("b").agg(F.min("a").alias("a"), F.count("*").alias("k"), F.min("shared").alias("shared"), F.max(F.expr("n_a + n_b")).alias("sizes"))
    led = led.where("k = 1 AND 2 * shared = sizes")
    clusters = staged(
        components(links)
        .join(led.selectExpr("b AS node", "a AS leader_of"), "node", "left")
        .selectExpr("node AS doc", "coalesce(leader_of, node) AS leader_of", "component"),
        "clusters",
    )

    # Open lists are contracted round by round, each cluster against one leader.
    open_lists = _open_lists(lists, clusters)
    for number in range(ROUNDS):
        if open_lists.isEmpty():
            break
        linked = verifier.overlaps(_star_pairs(open_lists, sketches, percent, number)).where("linked").select("a", "b")
        links = links.unionAll(linked)
        open_lists = _contracted(open_lists, linked)

    # Sets of components that are still apart.
    linked = verifier.overlaps(_cluster_pairs(open_lists, sketches, percent)).where("linked").select("a", "b")
    final = components(links.unionAll(linked))
    return known.join(final, known.doc == final.node, "left").selectExpr(
        "doc AS doc_id", "n AS n_shingles", "coalesce(component, doc) AS component_id"
    )


def drop_near_copies(
    docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows whose id is the smallest of its component, with all their columns.

    Rows without id, or without words, belong to no group and stay; of rows that repeat an id all stay or go, and of
    equal texts the one with the smallest id stays. Only ids of rows that go, and rows that a bitmap of such ids holds,
    are shuffled; where the bitmap fills up more rows travel, and the result stays the same.
    """
    groups = jaccard_components(docs, ngram, percent, id_col, text_col)
    gone = staged(groups.where("component_id < doc_id").select(F.col("doc_id").alias("gone_id")).distinct(), "near-copies")
    names = docs.columns
    key = F.col(f"c{names.index(id_col)}").cast("long")
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    rows = marked(plain, F.xxhash64(key), gone.select(F.xxhash64("gone_id").alias("code")), "may_go")
    looked_at = rows.where("may_go").join(gone, key == gone["gone_id"], "left_anti")
    return rows.where("NOT may_go").unionAll(looked_at).drop("may_go").toDF(*names)
