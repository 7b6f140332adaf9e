"""The join against all pairs of sets."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from churnlake.llm import ngram_jaccard as join
from churnlake.llm.components import components
from churnlake.llm.ngram_jaccard import Parts, jaccard_components, prefix_size


def brute(rows, size=4, percent=85):
    sets = []
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            if a is not None and b is not None and sets[i] and sets[j]:
                if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return sorted((str(d), len(s), None if d is None else root(d)) for (d, _), s in zip(rows, sets))


def ours(df, **options):
    return sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard_components(df, **options).collect())


def near_copies(seed, groups=12, copies=9):
    """Groups of texts of several lengths with a few words changed, one shared passage, chains of drift."""
    pick = random.Random(seed)
    word = lambda: f"w{pick.randrange(4000)}"
    passage = [word() for _ in range(30)]
    rows, doc = [], 0
    for _ in range(groups):
        text = [word() for _ in range(pick.choice((3, 8, 40, 150)))]
        if pick.random() < 0.5:
            text += passage
        for _ in range(pick.randrange(1, copies)):
            if pick.random() < 0.7 and len(text) > 5:
                text[pick.randrange(len(text))] = word()
            rows.append((doc, " ".join(text)))
            doc += pick.randrange(1, 3)
    pick.shuffle(rows)
    return rows


def test_links_of_near_copies(spark, documents):
    for seed in (1, 2):
        rows = near_copies(seed)
        assert ours(documents(rows).repartition(5)) == brute(rows)


def test_other_sizes(spark, documents):
    rows = near_copies(3)
    assert ours(documents(rows).repartition(3), ngram=5, percent=80) == brute(rows, 5, 80)


def test_members_that_link_where_leaders_do_not(spark, documents):
    """A long drift: each text links with its neighbours only, so leaders of a list rarely see the far ends."""
    base = [f"d{i}" for i in range(120)]
    rows = []
    for step in range(60):
        rows.append((step, " ".join(base)))
        base[step * 2] = f"e{step}"
    rows += [(500 + i, " ".join([*base[: 100 + i], "tail"])) for i in range(20)]
    assert ours(documents(rows).repartition(4)) == brute(rows)


def test_members_that_add_nothing_link_where_leaders_do_not(spark, documents):
    """A copy that only lacks the end of its leader adds no n-gram, yet links with an edit of itself."""
    rows = []
    for group in range(8):
        words = [f"g{group}x{i}" for i in range(113)]
        short = words[:98]
        rows += [(10 * group + k, " ".join(w)) for k, w in enumerate((words, short, [*short[:50], "edited", *short[51:]]))]
    assert ours(documents(rows).repartition(4)) == brute(rows)


def test_an_id_whose_second_text_does_not_link_with_its_leader(spark, documents):
    """The second text meets a text of another size class, in which no leader connects the two."""
    rows = []
    for group in range(0, 80, 10):
        first, second = ([f"{kind}{group}x{i}" for i in range(113)] for kind in "pq")
        texts = first, [*first[:50], "edited", *first[51:]], second, second[:97]
        rows += [(group + k, " ".join(w)) for k, w in zip((0, 1, 1, 5), texts)]
    assert ours(documents(rows).repartition(4)) == brute(rows)


def test_odd_rows(spark, documents, odd_rows):
    rows = [*odd_rows, (7, "A  b\nC d e"), (0, "a b c d e"), (8, "a B"), (4, "a b"), (9, "x y z"), (9, "a b c d e")]
    assert ours(documents(rows)) == brute(rows)
    assert ours(documents([])) == []


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.sampled_from((50, 80, 85, 100)))
def test_prefix_size(n, percent):
    assert prefix_size(n, percent) == n - -(-percent * n // 100) + 1


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 300), st.integers(0, 60), st.integers(0, 60), st.sampled_from((50, 80, 85, 100)), st.integers(0, 1 << 32))
def test_linked_sets_share_a_part(common, left, right, percent, seed):
    hashes = np.random.default_rng(seed).integers(0, 1 << 64, common + left + right, np.uint64)
    a, b = np.unique(hashes[: common + left]), np.unique(np.concatenate((hashes[:common], hashes[common + left :])))
    if 100 * common >= percent * (common + left + right):
        cut = Parts(percent)
        shared = set(cut.cut(a)[0]) & set(cut.cut(b)[0])
        number = min(c[0] for c in cut.classes(min(len(a), len(b))) if cut.highs[c[0]] >= min(len(a), len(b)))
        assert shared
        assert sum(int(key) & 63 == number & 63 for key in shared) >= cut.least(number) - (left + right)


def test_passages_that_many_short_texts_share(spark, documents):
    """Texts of a common passage and words of their own, some pairs just over the least similarity, some below it."""
    pick, rows = random.Random(6), []
    passage = [f"p{i}" for i in range(60)]
    for doc in range(150):
        own = [f"o{pick.randrange(6)}x{i}" for i in range(pick.randrange(2, 16))]
        rows.append((doc, " ".join(passage + own)))
    assert ours(documents(rows).repartition(4)) == brute(rows)
    assert ours(documents(rows).repartition(4), ngram=5, percent=80) == brute(rows, 5, 80)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2000), st.integers(0, 300), st.integers(0, 300), st.integers(0, 1 << 32))
def test_sketches_differ_no_more_than_sets(common, left, right, seed):
    hashes = np.random.default_rng(seed).integers(0, 1 << 64, common + left + right, np.uint64)
    a, b = np.unique(hashes[: common + left]), np.unique(np.concatenate((hashes[:common], hashes[common + left :])))
    apart = sum(int(x).bit_count() for x in (join.sketch(a) ^ join.sketch(b)).view(np.uint64))
    assert apart <= len(np.setxor1d(a, b)) and (left + right > 20 or apart >= (left + right) / 2)


def test_pairs_of_a_group_below_the_least_similarity(spark, documents, monkeypatch):
    """Texts that share most parts but do not link are not compared pair by pair; those that link are found."""
    pick, base = random.Random(9), [f"b{i}" for i in range(200)]
    rows = []
    for doc in range(80):
        words = list(base)
        for place in pick.sample(range(200), 8):
            words[place] = f"o{doc}x{place}"
        rows.append((doc, " ".join(words)))
    rows.append((99, rows[50][1] + " tail"))
    seen, whole = [], join._Verifier.overlaps
    monkeypatch.setattr(join._Verifier, "overlaps", lambda self, pairs: seen.append(whole(self, pairs)) or seen[-1])
    assert ours(documents(rows).repartition(4)) == brute(rows)
    assert sum(pairs.count() for pairs in seen) < 200  # of 3,240


def test_components(spark):
    links = [(i, i + 1) for i in range(70)] + [(100, 200), (200, 100), (300, 300)] + [(1000, 1001 + i) for i in range(50)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(71)} | {100: 100, 200: 100} | {1000 + i: 1000 for i in range(51)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
