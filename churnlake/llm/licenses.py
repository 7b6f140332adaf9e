"""License scans with a positional index of rare tokens.

Each template is a run of words with mandatory phrases in it. The corpus tells how rare the words of the phrases are
(one pass that counts, for every such word, the documents that hold it). The ``RARE`` words of highest IDF among a
template's phrases are its postings: (word, template, position). A file whose words meet no posting is done; in any
other file each posting word looks up the postings, and every meeting proposes a start of the template: the word's
position in the file less its position in the template. Where the phrases stand, all postings of the template agree,
whatever the words around them; so a start is a candidate only if all agree, and then the mandatory phrases must stand
at their places word for word. Every place of every template is found, also where the words before or after the phrases
differ or are cut off by the end of the text; which places a file has depends on no other file. There is no limit on
words or places.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlake.llm.common import NO_WORD, lower_ascii, pick

RARE = 3


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...]
    base: bool = False


#: Phrases that every scan reports.
BASE = (
    Template("mit", "mit license", ("mit license",), True),
    Template("apache", "apache license", ("apache license",), True),
    Template("gpl", "general public license", ("general public license",), True),
)
#: Opening words of public licences and notices, with the phrases that identify them.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("mit-notice", "released under the mit license", ("mit license",)),
    Template(
        "mit-grant",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files",
        ("permission is hereby granted free of charge", "obtaining a copy of this software"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the"
        " following conditions are met",
        ("redistribution and use in source and binary forms", "conditions are met"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("permission to use copy modify and or distribute this software",),
    ),
    Template(
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license v 2 0",),
    ),
    Template(
        "cc-by-4.0",
        "this work is licensed under a creative commons attribution 4 0 international license",
        ("creative commons attribution 4 0 international",),
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        ("free and unencumbered software",),
    ),
    Template(
        "lgpl",
        "under the terms of the gnu lesser general public license as published by the free software foundation",
        ("gnu lesser general public license",),
    ),
    Template(
        "agpl-3.0",
        "under the terms of the gnu affero general public license as published by the free software foundation",
        ("gnu affero general public license",),
    ),
    Template(
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
        " license as published by the free software foundation",
        ("free software you can redistribute it and or modify it", "gnu general public license"),
    ),
    Template(
        "bsd-endorsement",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
        " derived from this software without specific prior written permission",
        ("endorse or promote products derived from this software", "prior written permission"),
    ),
    Template(
        "boost",
        "distributed under the boost software license version 1 0",
        ("boost software license",),
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable"
        " for any damages arising from the use of this software",
        ("provided as is without any express or implied warranty", "in no event will the authors be held liable"),
    ),
    Template(
        "epl-2.0",
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
        ("eclipse public license 2 0",),
    ),
    Template(
        "cc0-1.0",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
        ("waived all copyright and related or neighboring rights",),
    ),
    Template(
        "cc-by-sa-4.0",
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
        ("creative commons attribution sharealike 4 0 international",),
    ),
    Template(
        "cc-by-nc-4.0",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
        ("creative commons attribution noncommercial 4 0 international",),
    ),
)


def words_of(text: Column) -> Column:
    """Lower-cased words of letters, digits and non-ASCII characters; no words for a null text."""
    plain = F.btrim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), NO_WORD, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _array(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def document_counts(docs: DataFrame, vocabulary: Sequence[str], text_col: str = "text") -> dict[str, int]:
    """In how many rows each word of the vocabulary occurs: one row for each word reaches the driver."""
    words = pick(docs, text=text_col).select(words_of(F.col("text").cast("string")).alias("words"))
    met = words.select(F.explode(F.array_intersect("words", _array(vocabulary))).alias("word"))
    counts = {row["word"]: row["count"] for row in met.groupBy("word").count().collect()}
    return {word: counts.get(word, 0) for word in vocabulary}


def phrase_places(template: Template) -> list[tuple[int, list[str]]]:
    """Where each mandatory phrase stands in its template, and its words."""
    own, places = template.text.split(), []
    for phrase in template.phrases:
        parts = phrase.split()
        places.append((next(i for i in range(len(own)) if own[i : i + len(parts)] == parts), parts))
    return places


def rare_postings(templates: Sequence[Template], counts: dict[str, int]) -> list[tuple[str, str, int]]:
    """(word, template, position): the rarest words of each template's phrases; of equal ones the first."""
    postings = []
    for template in templates:
        mandatory = sorted({(at + i, word) for at, parts in phrase_places(template) for i, word in enumerate(parts)})
        rarest = sorted(mandatory, key=lambda m: (counts[m[1]], m[0]))[:RARE]
        postings += [(word, template.label, position) for position, word in rarest]
    return postings


def _template_table(spark, templates: Sequence[Template], postings) -> DataFrame:
    """One row for each posting with its template; a few dozen rows."""
    rows = []
    known = {t.label: t for t in templates}
    for word, label, position in postings:
        template = known[label]
        agree = sum(p[1] == label for p in postings)
        rows.append((word, label, position, template.text.split(), phrase_places(template), agree, template.base))
    kind = "word string, label string, position int, own array<string>, phrases array<struct<at: int, words: array<string>>>, agree int, base boolean"
    return spark.createDataFrame(rows, kind)


def scan_licenses(
    docs: DataFrame,
    templates: Sequence[Template] = BASE + NOTICES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, places array<struct<start, label, base, score>>, score of every row.

    places: every place where the phrases of a template stand, ascending by its first word (counted from 0; a
    template whose first words would lie before the text starts at 0); score of a place: the share of the template's
    words that stand there; of a row: the largest, or 0.

    Null and empty texts have no words and no places. Repeated rows and null ids are rows like any other;
    an empty table gives no rows. Other columns are ignored.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select(
        "doc_id", words_of(F.col("text").cast("string")).alias("words")
    )
    vocabulary = sorted({word for t in templates for phrase in t.phrases for word in phrase.split()})
    counts = document_counts(docs, vocabulary, text_col)
    # A template with a mandatory word that no text holds cannot stand anywhere.
    templates = [t for t in templates if all(counts[word] for phrase in t.phrases for word in phrase.split())]
    postings = rare_postings(templates, counts)
    words_met = _array(sorted({p[0] for p in postings}))
    meets = F.arrays_overlap("words", words_met)
    none = F.expr("CAST(array() AS array<struct<start: bigint, label: string, base: boolean, score: double>>)")
    plain = rows.where(~meets).select(
        "doc_id", F.size("words").cast("long").alias("n_words"), none.alias("places"), F.lit(0.0).alias("score")
    )
    index = F.broadcast(_template_table(docs.sparkSession, templates, postings))
    numbered = F.transform("words", lambda word, at: F.struct(at.alias("at"), word.alias("word")))
    met = (
        rows.where(meets)
        .withColumn("row", F.monotonically_increasing_id())
        .select(
            "row", "doc_id", F.size("words").cast("long").alias("n_words"), "words",
            F.explode(F.filter(numbered, lambda x: F.array_contains(words_met, x["word"]))).alias("x"),
        )
        .select("row", "doc_id", "n_words", "words", "x.at", "x.word")
        .join(index, "word")
        .selectExpr(
            "row", "doc_id", "n_words", "label", "at - position AS start",
            "concat(array_repeat(cast(null AS string), greatest(0, position - at)),"
            " slice(words, greatest(0, at - position) + 1, size(own) - greatest(0, position - at))) AS region",
            "own", "phrases", "agree", "base",
        )
    )
    proposed = met.groupBy("row", "doc_id", "n_words", "label", "start").agg(
        F.count("*").alias("met"), *[F.first(c).alias(c) for c in ("region", "own", "phrases", "agree", "base")]
    )
    same = "size(filter(sequence(1, size(own)), i -> get(region, i - 1) = own[i - 1])) / size(own)"
    stands = "forall(phrases, p -> slice(region, p.at + 1, size(p.words)) = p.words)"
    checked = proposed.selectExpr(
        "row", "doc_id", "n_words",
        f"CASE WHEN met = agree AND {stands} THEN"
        f" struct(cast(greatest(0, start) AS bigint) AS start, label, base, {same} AS score) END AS place",
    )
    scanned = (
        checked.groupBy("row", "doc_id", "n_words")
        .agg(F.array_sort(F.collect_list("place")).alias("places"))
        .select("doc_id", "n_words", "places", F.expr("coalesce(array_max(transform(places, p -> p.score)), 0D)").alias("score"))
    )
    return plain.unionByName(scanned)
