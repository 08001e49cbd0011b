import hashlib
from collections import defaultdict

import pytest

from essenta.llm import exact_dedup
from essenta.llm.common import Folder
from essenta.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from tests.llm.odd import lowered, odd, table


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[lowered(r.text)].append(r.doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("first", [1, 64])
def test_odd_rows(spark, monkeypatch, first):
    monkeypatch.setattr(exact_dedup, "FIRST", first)
    docs = odd(spark)
    got = exact_duplicates(docs).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == brute(docs.collect())
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_table_and_clashing_columns(spark):
    docs = table(spark, "documents")
    got = exact_duplicates(docs.selectExpr("*", "1 as kept", "2 as rid", "text as b", "doc_id as keep_id")).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == brute(docs.collect())


def test_dropping_keeps_columns(spark):
    docs = odd(spark).selectExpr("*", "7 as rid", "8 as kept")
    left = drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert left.count() == len({lowered(r.text) for r in docs.collect()})


def test_no_rows(spark):
    assert exact_duplicates(odd(spark, [])).collect() == []
    assert drop_exact_duplicates(odd(spark, [])).collect() == []


def test_row_numbers_do_not_follow_the_splits(spark, tmp_path):
    docs = spark.range(4_000).selectExpr("id as doc_id", "concat('text ', id) as text")
    docs.repartition(3).write.option("parquet.block.size", 4_096).parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs")).where("doc_id >= 0").select("text", "doc_id")
    numbered, seen, parts = Folder(spark, "test").numbered(docs, "rid"), [], []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in [before, "3000"]:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        view = numbered.select("rid", "doc_id")  # planned anew
        seen.append({r.rid: r.doc_id for r in view.collect()})
        parts.append(view.rdd.getNumPartitions())
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert parts[0] != parts[1] and seen[0] == seen[1] and len(seen[0]) == 4_000


def test_row_numbers_are_unique_when_files_repeat(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(9).selectExpr("id as doc_id", "'t' as text").write.parquet(path)
    twice = Folder(spark, "test").numbered(spark.read.parquet(path, path), "rid")
    assert twice.count() == twice.select("rid").distinct().count()
