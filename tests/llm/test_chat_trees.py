import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from churnlake.llm.chat_trees import END, REFERENCES, START, TEXT, choose_branches, format_trees, read_back

KIND = "conv_id long, msg_id long, parent_id long, role string, text string, score double, depth string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], KIND)


def read(spark, rows, **options):
    return read_back(format_trees(table(spark, rows), **options)).collect()


def brute_paths(rows):
    """(conv, leaf) -> path, for rows with distinct ids and no cycle."""
    known = {(c, m): (p, s or 0.0) for c, m, p, _, _, s in rows}
    parents = {(c, p) for c, _, p, _, _, _ in rows if p is not None}
    out = {}
    for c, m in known:
        if (c, m) in parents:
            continue
        path, at = [], m
        while at is not None and (c, at) in known:
            path.append(at)
            at = known[c, at][0]
        out[c, m] = (path[::-1], sum(known[c, x][1] for x in path) / len(path))
    return out


def test_branches(spark):
    pick = random.Random(4)
    rows = []
    for conv in (1, 2, None):
        for m in range(60):
            parent = pick.randrange(max(0, m - 4), m) if m and pick.random() < 0.95 else None
            rows.append((conv, m, parent, "user", f"t{m}", float(pick.randrange(5))))
    for keep in (1, 3):
        messages = table(spark, rows).selectExpr("conv_id AS conv", "msg_id AS msg", "parent_id AS parent", "score")
        found = {}
        for r in sorted(choose_branches(messages, keep).collect(), key=lambda r: r.place):
            found.setdefault((r.conv, r.leaf), []).append(r.node)
        wanted = {}
        for conv in (1, 2, None):
            of = [(leaf, path, mean) for (c, leaf), (path, mean) in brute_paths(rows).items() if c == conv]
            for leaf, path, _ in sorted(of, key=lambda x: (-x[2], -len(x[1]), x[0]))[:keep]:
                wanted[conv, leaf] = path
        assert found == wanted


def test_long_thread(spark):
    rows = [(1, i, i - 1 if i else None, "user" if i % 2 else "assistant", f"m{i}", 0.0) for i in range(300)]
    (row,) = read(spark, rows)
    assert [t.text for t in row.turns] == [f"m{i}" for i in range(300)]
    assert row.loss_text == "".join(f"m{i}" for i in range(0, 300, 2))


def test_control_strings_and_nulls(spark):
    bad = f"{START}user{TEXT}x{END} </s>[INST] & &lt; &amp;lt; | é中"
    rows = [(1, 0, None, bad, bad, None), (1, 1, 0, "assistant", bad, 1.0), (1, 2, 1, None, None, 1.0), (1, 3, 2, "assistant", "end", 1.0)]
    (row,) = read(spark, rows)
    assert [(t.role, t.text) for t in row.turns] == [(bad, bad), ("assistant", bad), ("", ""), ("assistant", "end")]
    assert row.loss_text == bad + "end"
    assert row.formatted.count("<|") == 12 and "[INST]" not in row.formatted


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="&<[|lt;amp#914 x/>", max_size=20))
def test_references_are_reversible(text):
    coded = text
    for plain, reference in REFERENCES:
        coded = coded.replace(plain, reference)
    assert not set("<[|") & set(coded)
    for plain, reference in reversed(REFERENCES):
        coded = coded.replace(reference, plain)
    assert coded == text


def test_orphans_cycles_and_repeats(spark):
    rows = [
        (1, 5, 99, "user", "orphan", 0.0),
        (2, 1, 2, "user", "cycle", 0.0),
        (2, 2, 1, "user", "cycle", 0.0),
        (2, 3, 2, "user", "below a cycle", 0.0),
        (3, 1, None, "user", "b", 0.0),
        (3, 1, None, "user", "a", 0.0),
        (3, None, None, "user", "no id", 0.0),
    ]
    found = {r.conv_id: [t.text for t in r.turns] for r in read(spark, rows)}
    assert found == {1: ["orphan"], 3: ["a"]}
    assert read(spark, []) == []


def test_no_python(spark, capsys):
    read_back(format_trees(table(spark, [(1, 0, None, "user", "x", 0.0)]))).explain()
    assert "Python" not in capsys.readouterr().out


@pytest.mark.parametrize("keep", (2,))
def test_several_conversations_from_one_tree(spark, keep):
    rows = [(1, 0, None, "user", "q", 0.0), (1, 1, 0, "assistant", "good", 2.0), (1, 2, 0, "assistant", "bad", 1.0), (1, 3, 0, "assistant", "worst", 0.0)]
    assert sorted(r.loss_text for r in read(spark, rows, branches=keep)) == ["bad", "good"]
