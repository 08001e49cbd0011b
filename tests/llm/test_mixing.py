from collections import defaultdict

from essenta.llm.mixing import mix_sources, mixture
from tests.llm.odd import odd, table, words


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, closed = sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in order if s not in closed)
        level = (total - sum(3 * sizes[s] for s in closed)) / free if free else 0
        more = {s for s in order if s not in closed and weight[s] * level >= 3 * sizes[s]}
        if not more:
            return {s: 3 * sizes[s] if s in closed else weight[s] * level for s in order}
        closed |= more


def check(docs, got, near):
    sizes = defaultdict(int)
    for r in docs:
        sizes[r.source] += len(words(r.text))
    want, taken = targets(sizes), defaultdict(int)
    assert len(got) == len(docs)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.copies <= 3
        taken[r.source] += r.size * r.copies
    for s, t in want.items():
        assert abs(taken[s] - t) <= near(s)


def test_targets_are_met(spark):
    docs = table(spark, "documents")
    rows = docs.collect()
    got = mix_sources(docs).collect()
    assert sorted((r.doc_id, r["size"]) for r in got) == sorted((r.doc_id, len(words(r.text))) for r in rows)
    longest = defaultdict(int)
    for r in rows:
        longest[r.source] = max(longest[r.source], len(words(r.text)))
    check(rows, [r for r in got], lambda s: longest[s])


def test_reruns_agree(spark):
    docs = table(spark, "documents").select("doc_id", "text", "source")
    again = docs.repartition(3)
    pick = lambda d: sorted((r.doc_id, r.copies) for r in mix_sources(d).collect())
    assert pick(docs) == pick(again)


def test_odd_rows_and_names(spark):
    docs = odd(spark).selectExpr("*", "1 as size", "2 as target", "3 as sid", "4 as copies")
    got = mix_sources(docs)
    assert got.columns == [*docs.columns, "size_", "source_size", "target_", "copies_"]
    assert got.count() == docs.count()
    assert all(r.size_ == len(words(r.text)) for r in got.collect())
    mixed = mixture(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies_ for r in got.collect())


def test_no_rows_and_no_words(spark):
    assert mix_sources(odd(spark, [])).collect() == []
    empty = mix_sources(odd(spark, [(1, None, "en", "a", 0), (2, " ", "en", None, 1)])).collect()
    assert [(r["size"], r.target) for r in empty] == [(0, 0.0), (0, 0.0)]


def test_plan_has_no_python(spark):
    plan = mix_sources(table(spark, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
