"""The whole pipeline against a brute-force run of its rules, and the registered queries that SQL can state."""

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from churnlake.llm import decontamination, toxicity
from churnlake.llm.common import id_remainder
from churnlake.llm.queries import ORACLES, QUERIES
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_ngram_jaccard import brute as groups
from tests.oracle import connect, differences

FOLDER = "/root/testdata/sf0.001"


def test_pipeline_keeps_what_brute_force_keeps(spark, small):
    docs = small("documents")
    model = toxicity.fit_toxicity(docs, small("labels"), id_remainder(F.col("doc_id")) != 0)
    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, model).where("score >= 0.5").collect()}
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id not in toxic]
    first = {d: c for d, _, c in groups(rows, 5, 80)}
    rows = [(d, t) for d, t in rows if first[str(d)] == d]
    items = [(r.item_id, r.text) for r in small("benchmark").collect()]
    hit = {d for d, _, n, _ in leaks(rows, items) if n}
    rows = [(d, t) for d, t in rows if str(d) not in hit]
    library = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    expected = sorted((d, library.encode(t or "", add_special_tokens=False).ids) for d, t in rows)
    assert sorted((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, FOLDER).collect()) == expected
    assert len(expected) > 100


def test_stages_keep_the_columns(spark, small, documents, odd_rows):
    docs = documents(odd_rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, FOLDER)
        assert kept.columns == docs.columns
        assert kept.where("text IS NULL").count() == 2  # clean rows stay
        assert stage(spark, documents([]), FOLDER).collect() == []
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert last.count() == len(odd_rows)


def test_filters_judge_each_row_by_its_own_text(spark, small, documents):
    """Of rows that repeat an id, or have none, only those that hold a benchmark passage or toxic words go."""
    item = max((r.text for r in small("benchmark").collect() if r.text), key=len)
    rows = [(1, "clean text"), (1, f"before {item} after"), (None, item), (None, None), (2, "")]
    kept = decontamination.drop_contaminated(documents(rows).repartition(2), small("benchmark"))
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, (rows[0], rows[3], rows[4])))
    model = toxicity.ToxicityModel({b"scum": 4.0}, 1.0, -2.0, (-3.0, 1.0, 0.0))
    rows = [(1, "calm words"), (1, "scum scum scum"), (None, "scum scum"), (None, None)]
    kept = toxicity.drop_toxic(documents(rows), model)
    assert kept.columns == documents(rows).columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, (rows[0], rows[3])))


def test_every_block_of_a_benchmark_filters(spark, small, documents, monkeypatch):
    docs, items = small("documents"), small("benchmark")
    hit = {r.doc_id for r in decontamination.find_contamination(docs, items).where("n_hit > 0").collect()}
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 4096)
    left = {r.doc_id for r in decontamination.drop_contaminated(docs, items).select("doc_id").collect()}
    assert hit and left == {r.doc_id for r in docs.select("doc_id").collect()} - hit


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_with_sql(spark, name):
    assert differences(spark, connect(FOLDER), FOLDER, name, QUERIES, ORACLES) is None


