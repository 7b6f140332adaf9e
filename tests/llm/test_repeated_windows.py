import random

import pytest

from churnlake.llm import repeated_windows
from churnlake.llm.repeated_windows import remove_repeats


def brute(rows, window):
    texts = [(t or "").encode() for _, t in rows]
    starts = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - window + 1):
            starts.setdefault(t[p : p + window], []).append((i, p))
    covered = [bytearray(len(t)) for t in texts]
    for places in starts.values():
        for i, p in places if len(places) > 1 else []:
            covered[i][p : p + window] = b"\1" * window
    out = []
    for (doc, _), t, c in zip(rows, texts, covered):
        edges = [i for i in range(len(t) + 1) if (c[i - 1] if i else 0) != (c[i] if i < len(t) else 0)]
        out.append((str(doc), len(t), list(zip(edges[::2], edges[1::2])), bytes(b for b, x in zip(t, c) if not x)))
    return sorted(out)


def ours(frame, window):
    return sorted(
        (str(r.doc_id), r.n_bytes, [(s.start, s.end) for s in r.removed], bytes(r.kept)) for r in remove_repeats(frame, window).collect()
    )


def sample(seed):
    pick = random.Random(seed)
    text = lambda n, letters="abcdé ": "".join(pick.choices(letters, k=n))
    base, passage = text(700), text(90)
    rows = [(i, text(pick.randrange(400))) for i in range(15)]
    for i in range(20, 60):  # near copies, shifted and cut
        near = list(base[pick.randrange(60) : 700 - pick.randrange(60)])
        for _ in range(pick.randrange(4)):
            near[pick.randrange(len(near))] = "x"
        rows.append((i, "".join(near)))
    rows += [(i, text(50) + passage[pick.randrange(40) :] + text(60)) for i in range(60, 90)]
    rows += [(90, "a" * 500), (91, "ab" * 300), (92, "a" * 64), (93, base), (94, base), (94, base), (95, text(300, "ab"))]
    rows += [(96, passage + text(20) + passage), (None, passage + passage[:70]), (97, None), (98, ""), (99, "a" * 63)]
    return rows


@pytest.mark.parametrize("seed,group", [(1, 1000), (2, 3)])
def test_equals_brute_force(documents, monkeypatch, seed, group):
    monkeypatch.setattr(repeated_windows, "GROUP", group)
    rows = sample(seed)
    for window in (64, 37) if group > 3 else (64,):
        assert ours(documents(rows), window) == brute(rows, window)


def test_chunks_do_not_matter(documents, monkeypatch):
    rows = sample(3)
    assert repeated_windows.strips(b"", 64)[0].size == 0
    monkeypatch.setattr(repeated_windows, "CHUNK", 100)
    first, end, *_ = repeated_windows.strips(rows[20][1].encode(), 64)
    assert first[0] == 0 and end[-1] == len(rows[20][1].encode()) and (first[1:] == end[:-1] - 63).all()


def test_odd_rows_and_empty_table(documents, odd_rows):
    found = remove_repeats(documents(odd_rows))
    rows = {(r.doc_id, r.n_bytes): r for r in found.collect()}
    assert len(odd_rows) == found.count()
    long = next(r for r in rows.values() if r.doc_id == 4)
    assert len(long.removed) == 1 and len(long.kept) == 0  # the words come round again
    assert rows[(1, 0)].kept == b"" and rows[(5, 3)].kept == b"a b"
    assert remove_repeats(documents([])).collect() == []
