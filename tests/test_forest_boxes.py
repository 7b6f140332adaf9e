import numpy as np
import pyarrow as pa
import pytest

from churnlake.operators import forest_shap as forest

KIND = pa.list_(pa.struct([("feature", pa.int32()), ("low", pa.float64()), ("high", pa.float64())]))


def grown(pick, width, leaves):
    """Leaves of a random tree as (tree, leaf, value, {feature: (low, high)})."""
    boxes = [{}]
    while len(boxes) < leaves:
        box = boxes.pop(int(pick.integers(len(boxes))))
        f, cut = int(pick.integers(width)), float(np.round(pick.normal(), 1))
        low, high = box.get(f, (None, None))
        if (low is None or cut > low) and (high is None or cut < high):
            boxes += [{**box, f: (low, cut)}, {**box, f: (cut, high)}]
        else:
            boxes.append(box)
    return boxes


def table(boxes, trees):
    paths = [[{"feature": f, "low": a, "high": b} for f, (a, b) in sorted(box.items())] for box in boxes]
    columns = [pa.array(trees, pa.int32()), pa.array(range(len(boxes)), pa.int64()), pa.array(paths, KIND)]
    return pa.Table.from_arrays(columns, ["tree", "leaf", "path"])


def holds(x, low, high):
    return (np.isnan(x) | (x > (-np.inf if low is None else low))) & ((x <= (np.inf if high is None else high)) | (np.isnan(x) & (high is None)))


@pytest.mark.parametrize("kind", ["trees", "overlapping"])
def test_rows_find_their_boxes_and_masks(kind, monkeypatch):
    monkeypatch.setattr(forest, "LEAST_ROOM", 40)
    pick = np.random.default_rng(3)
    boxes = grown(pick, 5, 60) + grown(pick, 5, 30) + [{}]
    trees = [0] * 60 + [1] * 30 + [2]
    if kind == "overlapping":
        trees = [0] * len(boxes)
    x = np.round(pick.normal(size=(500, 5)), 1)
    x[pick.random((500, 5)) < 0.05] = np.nan
    leaves = table(boxes, trees)
    inside = {i: np.flatnonzero(np.all([holds(x[:, f], *c) for f, c in box.items()] or [np.ones(500, bool)], axis=0)) for i, box in enumerate(boxes)}
    made, found = forest._Boxes.of(leaves), {}
    for tree in sorted(set(trees)):
        for i, rows in forest._located(x, made, np.flatnonzero(made.trees == tree)):
            place = int(made.places[i])
            assert place not in found
            found[place] = np.sort(rows)
    assert {i: r.tolist() for i, r in found.items()} == {i: r.tolist() for i, r in inside.items() if len(r)}
    met, packs = set(), 0
    for back, count, masks in forest._pack_masks(x, leaves):
        packs += 1
        for place, path, mask in masks:
            met.add(place)
            expected = sum((holds(x[:, f], *boxes[place][f]).astype(int) << i for i, f in enumerate(path)), np.zeros(500, int))
            assert len(mask) == count and path == sorted(boxes[place]) and (mask[back] == expected).all()
    assert met == set(range(len(boxes))) and 3 <= packs < len(boxes)
