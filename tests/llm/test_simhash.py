import numpy as np
import pytest
import xxhash

from essenta.llm import simhash
from essenta.llm.common import Folder
from essenta.llm.components import components
from essenta.llm.simhash import drop_near_duplicates, fingerprint, fingerprint_links, near_duplicates
from tests.llm.odd import lowered, odd, table, words


def brute_print(text, k=3):
    w = words(lowered(text))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(items, radius=2):
    """Smallest item that each position reaches; items are (id, fingerprint)."""
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(items):
        r = find(i)
        least[r] = min([k for k in (least.get(r), key) if k is not None], default=None)
    return [least[find(i)] for i in range(len(items))]


def test_table(spark):
    docs = table(spark, "documents")
    got = {r.doc_id: (r.fp, r.component_id) for r in near_duplicates(docs.selectExpr("doc_id + 5 as rid", "doc_id", "text")).collect()}
    rows = docs.collect()
    prints = {r.doc_id: brute_print(r.text) for r in rows}
    assert {k: v[0] % (1 << 64) for k, v in got.items()} == prints
    items = sorted(prints.items())
    assert [got[k][1] for k, _ in items] == brute_classes(items)


def test_odd_rows(spark):
    docs = odd(spark).selectExpr("*", "1 as fp", "2 as component_id", "3 as rid")
    rows = [r for r in docs.collect()]
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns
    classes = brute_classes([(k, brute_print(r.text)) for k, r in enumerate(rows)])
    assert left.count() == len(set(classes))
    assert fingerprint(None) == fingerprint(" \n") == 0
    assert drop_near_duplicates(odd(spark, [])).collect() == []


@pytest.mark.parametrize("shard", [20, 64])
def test_tree_finds_every_link(spark, monkeypatch, shard):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
    dense = np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    close = seeds ^ (np.uint64(1) << rng.integers(0, 64, 120).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 120).astype(np.uint64))
    points = np.unique(np.concatenate([seeds, close, close ^ np.uint64(3), dense]))
    monkeypatch.setattr(simhash, "LEAF", 4)
    frame = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
    links = fingerprint_links(frame, 2, shard)
    assert links.count() <= 20 * len(points)
    found = {r.node: r.root for r in components(links, Folder(spark, "test")).collect()}
    items = [(int(np.uint64(x).view(np.int64)), int(x)) for x in points]
    assert [found.get(k, k) for k, _ in items] == brute_classes(items)


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Folder(spark, "test")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{100 + k: 100 for k in range(40)}}
