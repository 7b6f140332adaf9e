import random

from churnlake.llm import decontamination
from churnlake.llm.decontamination import find_contamination

ITEMS = "item_id long, text string, doc_id string"


def brute_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if c.isascii() else c
        if not c.isascii() or c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        words = brute_words(text)
        for i in range(max(1, len(words) - size + 1) if words else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add("null" if item is None else str(item))
    out = []
    for doc, text in docs:
        words, hit, met = brute_words(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    met |= windows[tuple(words[i : i + n])]
        out.append((str(doc), len(words), len(hit), sorted(met)))
    return sorted(out)


def ours(spark, docs, items):
    found = find_contamination(docs, spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS))
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in found.collect())


def sample(seed):
    pick = random.Random(seed)
    words = ["The", "cat", "séance", "42", "x-ray", "don't", "中国", "tree", "a", "b"]
    items = [(i, " ".join(pick.choices(words, k=pick.choice((2, 5, 10, 14))))) for i in range(20)]
    items += [(None, "lone item"), (30, None), (31, "..."), (32, items[0][1])]
    docs = []
    for i in range(40):
        parts = [" ".join(pick.choices(words, k=8)) for _ in range(4)]
        if i % 2:
            parts.insert(2, pick.choice(items)[1] or "")
        docs.append((i, " ,\n".join(parts)))
    return docs, items


def test_against_brute_force(spark, documents, odd_rows, monkeypatch):
    docs, items = sample(1)
    docs += [*odd_rows, (77, "Lone, ITEM"), (78, "lone items")]
    assert ours(spark, documents(docs), items) == brute(docs, items)
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 200)  # several blocks, one after the other
    assert ours(spark, documents(docs), items) == brute(docs, items)


def test_spans_are_original_text(spark, documents):
    text = "Ünder — The  CAT,sat on\nthe mat! é end"
    items = spark.createDataFrame([(1, "the cat sat on the mat", "x")], ITEMS)
    row = find_contamination(documents([(1, text)]), items).first()
    assert [text[s.start : s.end] for s in row.spans] == ["The  CAT,sat on\nthe mat"]
    assert (row.n_hit, row["items"]) == (6, ["1"])


def test_empty_tables(spark, documents):
    assert ours(spark, documents([]), [(1, "a b")]) == []
    assert ours(spark, documents([(1, "a b")]), []) == [("1", 2, 0, [])]
