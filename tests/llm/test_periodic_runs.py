import hashlib
import random
import zlib

import pytest

from churnlake.llm import periodic_runs
from churnlake.llm.periodic_runs import find_runs, z_function
from churnlake.llm.queries import op11_periodic_runs


def brute(words):
    """Every period is tried; a stretch counts for its smallest one."""
    least: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                least.setdefault((i, j - i + q), q)
            i = j + 1
    runs = sorted((s, q, n) for (s, n), q in least.items())
    gone = {i for s, q, n in runs for i in range(s + q, s + n)}
    return [(s, n, q) for s, q, n in runs], [w for i, w in enumerate(words) if i not in gone]


def ours(frame):
    return sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], bytes(r.collapsed)) for r in find_runs(frame).collect())


def expected(rows):
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        runs, left = brute(words)
        out.append((str(doc), len(words), runs, b" ".join(left)))
    return sorted(out)


def sample(seed):
    pick = random.Random(seed)
    rows = []
    for doc in range(150):
        letters = "ab" if doc % 3 == 0 else "abcdefghij"
        words = pick.choices(letters, k=pick.randrange(60))
        for _ in range(pick.randrange(4)):
            root = pick.choices(letters, k=pick.choice((1, 1, 2, 3, 5, 8, 13, 33)))
            words += (root * 12)[: pick.randrange(1, 10 * len(root) + 8)] + pick.choices(letters, k=pick.randrange(3))
        rows.append((doc, pick.choice((" ", "\n", " \t")).join(words)))
    nested = (["a"] * 9 + ["b"]) * 6
    return [*rows, (200, " ".join(nested)), (201, "é " * 6), (202, "x " * 5), (203, "x y " * 4), (204, "x " * 700), (204, "x y z " * 99)]


@pytest.mark.parametrize("strip", [1 << 16, 16])
def test_equals_brute_force(documents, monkeypatch, strip):
    monkeypatch.setattr(periodic_runs, "STRIP_WORDS", strip)
    rows = sample(strip)
    assert ours(documents(rows)) == expected(rows)


def test_z_function():
    assert z_function([1, 1, 2, 1, 1, 2, 1]) == [7, 1, 0, 4, 1, 0, 1]


def test_odd_rows_and_empty_table(documents, odd_rows):
    rows = [r for r in odd_rows if r[0] != 4]
    assert ours(documents(rows)) == expected(rows)
    long = next(r for r in ours(documents([odd_rows[3]])))
    assert long[1:3] == (60_000, [(0, 60_000, 997)]) and len(long[3].split()) == 997
    assert ours(documents([])) == []


def test_query_on_the_smallest_tables(spark):
    folder = "/root/testdata/sf0.001"
    want = []
    for row in spark.read.parquet(f"{folder}/documents.parquet").collect():
        words = (row.text or "").encode().split()
        h, n = zlib.crc32(str(row.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        runs, left = brute(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        digests = (hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(left)).hexdigest())
        want.append((row.doc_id, len(runs), *top, *digests))
    assert sorted(tuple(r) for r in op11_periodic_runs(spark, folder).collect()) == sorted(want)
    assert sum(r[1] > 0 for r in want) > 5
