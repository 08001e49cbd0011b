import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from essenta.llm.packing import evolve, pack, pack_documents
from tests.llm.odd import odd, table


def check(docs, got, capacity=1024):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in docs:
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % capacity or min(capacity, len(ids))
        starts = [0, *range(first, len(ids), capacity)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want.append((r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=repr) == sorted(want, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


def test_documents(spark):
    docs = table(spark, "documents")
    got = pack_documents(docs).collect()
    sequences = check(docs.collect(), got)
    assert sequences <= 1.01 * sum(r.length for r in got) / 1024 + 1


def test_odd_rows(spark):
    docs = odd(spark, [*odd(spark).collect(), (20, "a <|endoftext|> b", "en", "a", 1), (21, "x  y \n\n z", "en", "a", 1)])
    check(docs.collect(), pack_documents(docs.selectExpr("*", "1 as piece", "2 as bin", "3 as pid")).collect())


def test_ids_come_along(spark):
    docs = table(spark, "documents").limit(5)
    for r in pack_documents(docs, with_ids=True).collect():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32


@pytest.mark.parametrize("items", [20, 60])
def test_islands_and_migration(spark, items):
    pieces = spark.createDataFrame([(k, 1 + (k * 37) % 99) for k in range(300)] + [(300, 100)] * 20, "k long, length long")
    got = pack(pieces, capacity=100, island_items=items).collect()
    assert len(got) == 320 and sorted(r.k for r in got) == sorted(r.k for r in pieces.collect())
    fill = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 100
    assert len(fill) <= 1.1 * sum(r.length for r in got) / 100 + 2


def test_no_worse_than_given_and_best_fit():
    lengths = [60, 40, 50, 50, 70, 30, 20, 80, 99, 1]
    best = evolve(lengths, 100, [[k] for k in range(10)], [(60, 40), (7, 7)], 1)
    assert len(best.items) == 5 and sorted(i for b in best.items for i in b) == list(range(10))


def test_no_rows(spark):
    assert pack_documents(odd(spark, [])).collect() == []
