import random
import re

from churnlake.llm.licenses import BASE, NOTICES, Template, phrase_places, rare_postings, scan_licenses


def words(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def brute(rows):
    out = []
    for doc, text in rows:
        own = words(text)
        places = [
            (i, t.label) for t in BASE for i in range(len(own)) if own[i : i + len(t.text.split())] == t.text.split()
        ]
        out.append((str(doc), len(own), sorted(places)))
    return sorted(out)


TEXTS = [
    "The MIT License, and the mit-license; MIT  license",
    "Licensed under the Apache License, Version 2.0 (the License)",
    "This work is licensed under the GNU General Public License, version 3.",
    "general public general public license license mit apache",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated stuff",
    "Permission is hereby granted, free of care, to any person obtaining a copy of this software",
    "mit licenses apachelicense",
    "x " * 30000 + "apache license " * 500,
]


def test_base_places(spark, documents, odd_rows):
    rows = [(10 + i, t) for i, t in enumerate(TEXTS)] + odd_rows
    got = scan_licenses(documents(rows).repartition(3)).collect()
    ours = sorted((str(r.doc_id), r.n_words, sorted((p.start, p.label) for p in r.places if p.base)) for r in got)
    assert ours == brute(rows)
    assert all(0 <= r.score <= 1 for r in got)
    labels = {r.doc_id: {p.label for p in r.places} for r in got}
    assert labels[11] == {"apache", "apache-2.0"} and labels[12] == {"gpl", "gpl-3.0"}
    assert labels[14] == {"mit-grant"} and labels[15] == set()


def test_whole_notices(spark, documents):
    got = scan_licenses(documents([(i, f"intro {t.text}. outro") for i, t in enumerate(NOTICES)])).collect()
    for r in got:
        assert (NOTICES[r.doc_id].label, 1) in {(p.label, p.start) for p in r.places} and r.score == 1


def every_place(text, templates):
    """All places of all templates by trying each start, also those that begin before the text."""
    own, out = words(text), []
    for t in templates:
        told = t.text.split()
        for start in range(-len(told), len(own)):
            at = lambda i: own[start + i] if 0 <= start + i < len(own) else None  # noqa: E731, B023
            if all(at(p + i) == w for p, parts in phrase_places(t) for i, w in enumerate(parts)):
                score = sum(at(i) == w for i, w in enumerate(told)) / len(told)
                out.append((max(start, 0), t.label, t.base, round(score, 9)))
    return sorted(out)


def test_every_place_against_brute_force(spark, documents):
    """Notices with words changed, dropped, cut at either end or doubled, two of them running into each other."""
    pick, rows = random.Random(4), []
    for i in range(800):
        text = []
        for _ in range(pick.randrange(3)):
            own = pick.choice(NOTICES + BASE).text.split()
            for _ in range(pick.choice((0, 0, 1, 3))):
                at = pick.randrange(len(own))
                own[at : at + 1] = pick.choice(([], ["other"], [own[at]] * 2))
                own = own or ["x"]
            text += own[pick.choice((0, 0, 2, 5)) : len(own) - pick.choice((0, 0, 3))] + ["filler"] * pick.randrange(3)
        rows.append((i, " ".join(text)))
    got = scan_licenses(documents(rows).repartition(3)).collect()
    text = dict(rows)
    found = 0
    for r in got:
        ours = sorted((p.start, p.label, p.base, round(p.score, 9)) for p in r.places)
        assert ours == every_place(text[r.doc_id], BASE + NOTICES)
        assert round(r.score, 9) == max((p[3] for p in ours), default=0)
        found += len(ours)
    assert found > 300


def test_a_standing_phrase_is_found_whatever_other_files_hold(spark, documents):
    notice = "Permission to use, copy, modify, and/or distribute this software for any purpose is granted"
    for others in ([], ["fee hereby"] * 5, ["permission use copy modify distribute software purpose granted"] * 9):
        rows = [(0, notice), *[(i + 1, t) for i, t in enumerate(others)]]
        got = {r.doc_id: [p.label for p in r.places] for r in scan_licenses(documents(rows)).collect()}
        assert got[0] == ["isc"]


def test_phrases_at_the_edges_of_a_text(spark, documents):
    r = scan_licenses(documents([(1, "MIT License"), (2, "x released under the MIT License")])).orderBy("doc_id").collect()
    assert [(p.start, p.label, p.score) for p in r[0].places] == [(0, "mit", 1.0), (0, "mit-notice", 0.4)]
    assert [(p.start, p.label, p.score) for p in r[1].places] == [(1, "mit-notice", 1.0), (4, "mit", 1.0)]


def test_empty(spark, documents):
    assert scan_licenses(documents([])).collect() == []


def test_rarest_words_are_indexed():
    counts = {w: 10 for t in NOTICES + BASE for w in t.text.split()} | {"apache": 1, "license": 99}
    postings = rare_postings(BASE, counts)
    assert ("apache", "apache", 0) in postings and len(postings) == 2 + 2 + 3
    around = Template("t", "a rare mit license b", ("mit license",))
    counts |= {"a": 1, "rare": 1, "b": 1, "mit": 5}
    assert rare_postings([around], counts) == [("mit", "t", 2), ("license", "t", 3)]  # only words of the phrases


def test_no_python(spark, documents, capsys):
    scan_licenses(documents([(1, "mit license")])).explain()
    assert "Python" not in capsys.readouterr().out
