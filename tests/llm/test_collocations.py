import random
import re
from collections import Counter, defaultdict

import pytest

from churnlake.llm import collocations as module
from churnlake.llm.collocations import collocations


def brute(rows, longest=3, least=10, top=2000):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        text = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", text):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            total[lang or "und"] += len(words)
            for n in range(1, longest + 1):
                f[lang or "und"].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in kept.items():
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            inside = [b for q, b in kept.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if all(100 * b < 50 * a for b in inside):
                ranked.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, t, x, 1, "k") for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string, n long, `a.KEY` string")


def sample(seed):
    pick = random.Random(seed)
    words = ["New", "york", "city", "of", "the", "séance", "a-b", "中国", "x", "Y"]
    rows = []
    for _ in range(120):
        text = "".join(pick.choice(words[: pick.choice((4, 10))]) + pick.choice((" ", " ", " ", "\t ", ", ", ".\n")) for _ in range(pick.randrange(60)))
        rows.append((pick.choice(("en", "en", "de", None)), text))
    return [*rows, ("en", None), ("fr", ""), ("fr", " . "), ("und", "New york " * 15), ("en", rows[0][1]), ("en", "x" * 3000 + " the")]


@pytest.mark.parametrize("bits,longest", [(64, 3), (64, 4), (9, 3)])
def test_equals_brute_force(spark, monkeypatch, bits, longest):
    monkeypatch.setattr(module, "BITS", bits)  # with few bits most fingerprints collide
    rows = sample(bits)
    got = sorted(tuple(r) for r in collocations(table(spark, rows), longest=longest).collect())
    assert got == brute(rows, longest) and len(got) > 20


def test_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_RUNS", 50)
    rows = sample(5)
    got = sorted(tuple(r) for r in collocations(table(spark, rows), top=3).collect())
    assert got == brute(rows, top=3)


def test_empty_table(spark):
    assert collocations(table(spark, [])).collect() == []
