import zlib

import pytest

from churnlake.llm.sharding import shard_documents, write_shards


def check(rows, placed, shards):
    assert len(placed) == len(rows)
    assert sorted((str(r.doc_id), r.text_crc32, r["size"]) for r in placed) == sorted(
        (str(i), zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for i, t in rows
    )
    slots, weight = {}, [0] * shards
    for r in placed:
        slots.setdefault(r.shard, []).append(r.slot)
        weight[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return weight


def test_even_bytes(spark, documents):
    rows = [(i, "x" * (i * 7919 % 300)) for i in range(4000)] + [(9000 + i, "hot text " * 9) for i in range(2000)]
    placed = shard_documents(documents(rows).repartition(4), shards=7).collect()
    weight = check(rows, placed, 7)
    assert max(weight) - min(weight) <= 0.002 * sum(weight) / 7 + 2 * 316
    whole = {}
    for r in placed:
        whole.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(s) > 1 for s in whole.values()) <= 6  # a text is cut only where a border lies in it


def test_odd_rows(spark, documents, odd_rows):
    check(odd_rows, shard_documents(documents(odd_rows), shards=3).collect(), 3)
    assert shard_documents(documents([]), shards=3).collect() == []
    check(odd_rows, shard_documents(documents(odd_rows), shards=1).collect(), 1)
    with pytest.raises(ValueError):
        shard_documents(documents([]), shards=0)


def test_repeatable_and_pieces(spark, documents):
    rows = [(i, f"text {i % 50}") for i in range(300)]
    a = shard_documents(documents(rows), shards=4, piece_rows=10).select("doc_id", "shard", "slot").collect()
    b = shard_documents(documents(rows).repartition(6), shards=4, piece_rows=10).select("doc_id", "shard", "slot").collect()
    assert sorted(a) == sorted(b)
    check(rows, shard_documents(documents(rows), shards=4, piece_rows=10).collect(), 4)


def test_write(spark, documents, tmp_path):
    write_shards(shard_documents(documents([(i, str(i)) for i in range(50)]), shards=5), f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").groupBy("shard").count().count() == 5


def test_no_python(spark, documents, capsys):
    shard_documents(documents([(1, "a")]), shards=2).explain()
    assert "Python" not in capsys.readouterr().out
