"""SimHash near-duplicates, linked through a vantage-point tree over the fingerprints.

Distinct fingerprints are split into shards by a tree of vantage points: a node sends those
within its radius of its vantage point to one side and the others to the other side. Each
fingerprint is stored in one shard. It also goes, as a query, to every shard across a
boundary that the triangle inequality does not rule out, so each close pair meets in the
shard of one of its members. Inside a shard the tree goes on in memory down to small leaves,
which are compared exactly. A shard gives back the forest of its links, never all pairs;
components of the forests are the classes.

The tree is grown from a bounded hash sample of each oversized shard; a shard that is still
too large is split again, so shard sizes do not follow the input. The tree itself has at most
about ``2 * MOST_SHARDS`` nodes and is what the tasks get.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from essenta.llm.common import Folder, own_name
from essenta.llm.components import components

SHINGLE, RADIUS, SEED = 3, 2, 42
SHARD, MOST_SHARDS, SAMPLE, LEAF, BLOCK = 8_192, 65_536, 4_096, 512, 1 << 16
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles, repeats included; 0 for a text without words."""
    words = _WORDS.findall((text or "").encode().lower())  # bytes.lower changes A-Z only
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    n = len(words) - k + 1
    begin, end = start[:n].tolist(), (start[k - 1:] + size[k - 1:]).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(begin[at:at + BLOCK], end[at:at + BLOCK])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without its text column, with ``fp`` (the fingerprint's 64 bits as a long) last."""
    rest = [c for c in docs.columns if c != text]

    def step(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(len(rest)).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(_signed(fps), pa.int64())], names=[*rest, "fp"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text]
    return docs.select(*rest, text).mapInArrow(step, ", ".join([*fields, "fp long"]))


def _distance(points: np.ndarray, vantage) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage))


def _split(points: np.ndarray, radius: int, rng: np.random.Generator):
    """``vantage, mu`` with few points near the boundary and neither side small; None if no split."""
    probe = points if len(points) <= 1024 else rng.choice(points, 1024, replace=False)
    best = None
    for vantage in rng.choice(points, min(8, len(points)), replace=False):
        share = np.bincount(_distance(probe, vantage), minlength=65) / len(probe)
        inner = np.cumsum(share)
        near = np.convolve(share, np.ones(radius), "full")[:65]  # mass at mu - radius + 1 .. mu
        cost = near + 4 * np.maximum(0, 0.25 - np.minimum(inner, 1 - inner))
        cost[(inner <= 0) | (inner >= 1 - 1e-12)] = np.inf
        mu = int(cost.argmin())
        if np.isfinite(cost[mu]) and (best is None or cost[mu] < best[0]):
            best = float(cost[mu]), int(vantage), mu
    return best and best[1:]


def _grow(points: np.ndarray, leaves: int, radius: int, seed: int) -> list[tuple[int, int, int, int, int]]:
    """Nodes ``(number, vantage, mu, inner, outer)`` of a tree over a sample; children < 0 are leaves."""
    rng = np.random.default_rng(seed)
    nodes, count = [], 0

    def build(part: np.ndarray, leaves: int) -> int:
        nonlocal count
        found = _split(part, radius, rng) if leaves > 1 and len(part) >= 16 else None
        if found is None:
            count += 1
            return -count
        vantage, mu = found
        number = len(nodes)
        nodes.append(None)
        near = _distance(part, vantage) <= mu
        own = max(1, min(leaves - 1, round(leaves * near.mean())))
        inner, outer = build(part[near], own), build(part[~near], leaves - own)
        nodes[number] = (number, int(np.uint64(vantage).view(np.int64)), mu, inner, outer)
        return number

    build(points, leaves)
    return nodes


def _route(tree: dict, root: int, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``shard, indices, stored`` for every shard that some points go to, as stored ones or queries."""
    todo = [(root, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        at, idx, stored = todo.pop()
        if not len(idx):
            continue
        if at not in tree:
            yield at, idx, stored
            continue
        vantage, mu, inner, outer = tree[at]
        d = _distance(points[idx], np.int64(vantage).view(np.uint64)).astype(np.int64)
        keep = stored & (d <= mu)
        reach = keep | (~stored & (d <= mu + radius))
        todo.append((inner, idx[reach], stored[reach]))
        # a stored point of the inner side asks the outer side; the other direction would find the same pairs
        far = stored & (d > mu)
        reach = far | (d > mu - radius)
        todo.append((outer, idx[reach], far[reach]))


def _sharded(points: DataFrame, tree: dict, radius: int) -> DataFrame:
    """``shard, fp, stored`` of the distinct fingerprints ``points (fp)`` (root 0)."""
    shared = points.sparkSession.sparkContext.broadcast(tree)

    def step(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for shard, idx, stored in _route(shared.value, 0, fps, radius):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(idx), shard), pa.int64()), pa.array(_signed(fps[idx])), pa.array(stored)],
                    names=["shard", "fp", "stored"])

    return points.select("fp").mapInArrow(step, "shard long, fp long, stored boolean")


def _subtree(rates: dict, radius: int, seed: int):
    def step(rows: pd.DataFrame) -> pd.DataFrame:
        k = int(rows["shard"].iloc[0])
        nodes = _grow(np.sort(rows["fp"].to_numpy().view(np.uint64)), min(rates[k][1], SAMPLE // 16), radius, seed)
        return pd.DataFrame([(k, *x) for x in nodes], columns=["shard", "node", "vantage", "mu", "inner", "outer"])

    return step


def vantage_tree(points: DataFrame, n: int, radius: int, shard: int = SHARD) -> dict:
    """Global tree ``{node: (vantage, mu, inner, outer)}``; what is no node is a shard.

    Every round splits the shards above the capacity on a hash sample of at most about
    ``SAMPLE`` fingerprints each. The capacity rises with the input only to hold the number
    of shards at ``MOST_SHARDS``. Distinct points can always be split, so rounds end.
    """
    tree: dict = {}
    capacity, fresh = max(shard, n // MOST_SHARDS), 0
    sizes = {0: n} if n > capacity else {}
    for seed in range(64):
        if not sizes:
            break
        rates = {k: (min(1.0, SAMPLE / v), max(2, -(-2 * v // capacity))) for k, v in sizes.items()}

        stored = _sharded(points, tree, radius).where("stored").select("shard", "fp")
        wanted = points.sparkSession.createDataFrame([(k, v[0]) for k, v in rates.items()], "shard long, rate double")
        sample = stored.join(F.broadcast(wanted), "shard").where(  # MOST_SHARDS rows at most
            F.pmod(F.xxhash64("fp", F.lit(seed)), F.lit(1 << 30)) < F.col("rate") * float(1 << 30))
        grown = sample.groupBy("shard").applyInPandas(_subtree(rates, radius, seed), "shard long, node long, vantage long, mu long, inner long, outer long").collect()
        names: dict = {}
        for row in sorted(grown):  # names in a fixed order, so a retried task cannot change them
            for child in [row.node, row.inner, row.outer]:
                if (row.shard, child) not in names:
                    if child == 0:
                        names[row.shard, child] = row.shard
                    else:
                        fresh += 1
                        names[row.shard, child] = fresh
        for row in grown:
            tree[names[row.shard, row.node]] = (row.vantage, row.mu, names[row.shard, row.inner], names[row.shard, row.outer])
        counted = _sharded(points, tree, radius).where("stored").groupBy("shard").count().where(F.col("count") > capacity)
        sizes = {r["shard"]: r["count"] for r in counted.collect()}
    return tree


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links ``a-b`` reduced to ``(point, smallest point of its component)``."""
    points, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[:len(a)], ends[len(a):]
    label = np.arange(len(points))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(points))
    return points[moved], points[label[moved]]


def close_links(data: np.ndarray, queries: np.ndarray, radius: int, leaf: int = LEAF):
    """Yield forests of all links within ``radius`` between ``data`` and ``data`` or ``queries``."""
    rng = np.random.default_rng(len(data))
    todo = [(data, queries)]
    while todo:
        data, queries = todo.pop()
        if not len(data):
            continue
        found = _split(data, radius, rng) if len(data) > leaf else None
        if found is None:
            others = np.concatenate([data, queries])
            left, right = [], []
            for at in range(0, len(others), 4096):
                near = np.bitwise_count(data[:, None] ^ others[None, at:at + 4096]) <= radius
                i, j = np.nonzero(near)
                x, y = data[i], others[at + j]
                left.append(x[x != y])
                right.append(y[x != y])
            a, b = np.concatenate(left), np.concatenate(right)
            if len(a):
                yield _forest(a, b)
            continue
        vantage, mu = found
        d, q = _distance(data, vantage).astype(np.int64), _distance(queries, vantage).astype(np.int64)
        todo.append((data[d <= mu], queries[q <= mu + radius]))
        todo.append((data[d > mu], np.concatenate([queries[q > mu - radius], data[(d <= mu) & (d > mu - radius)]])))


def _shard_links(radius: int):
    def step(rows: pd.DataFrame) -> pd.DataFrame:
        fps, stored = rows["fp"].to_numpy().view(np.uint64), rows["stored"].to_numpy()
        data, queries = np.sort(fps[stored]), np.sort(fps[~stored])
        found = list(close_links(data, queries, radius))
        a = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.uint64)
        b = np.concatenate([y for _, y in found]) if found else np.empty(0, np.uint64)
        return pd.DataFrame({"a": _signed(a), "b": _signed(b)})

    return step


def fingerprint_links(points: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """``a, b``: a forest that connects exactly the fingerprints linked within ``radius``.

    ``points (fp)`` are distinct.
    """
    tree = vantage_tree(points, points.count(), radius, shard)
    return _sharded(points, tree, radius).groupBy("shard").applyInPandas(_shard_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE,
                    radius: int = RADIUS) -> DataFrame:
    """``rid, doc_id, fp, component_id, keep_rid`` of every row of ``docs (rid, doc_id, text)``.

    Two documents are linked when their fingerprints differ in at most ``radius`` bits; a
    component is everything reachable. Its id is the smallest doc_id in it (null only if all
    are null) and the row to keep is the one with the smallest ``(doc_id, rid)``, nulls last.
    Null and wordless texts have fingerprint 0 and link like any other. Repeated rows share a
    component. No rows give no rows.
    """
    folder = Folder(docs.sparkSession, "simhash")
    prints = folder.write(fingerprints(docs.select("rid", F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", shingle), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "rid"))
    points = folder.write(prints.groupBy("fp").agg(first.alias("first")), "points")
    edges = folder.write(fingerprint_links(points, radius), "links")
    roots = components(edges, folder)
    rooted = points.join(roots, points["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = folder.write(rooted, "rooted")
    classes = rooted.groupBy("root").agg(F.min("first").alias("top"))
    classes = rooted.select("fp", "root").join(classes, "root").select(
        "fp", F.col("top.doc_id").alias("component_id"), F.col("top.rid").alias("keep_rid"))
    return prints.join(folder.write(classes, "classes"), "fp").select("rid", "doc_id", "fp", "component_id", "keep_rid")


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE,
                         radius: int = RADIUS) -> DataFrame:
    """One row of each component, with all its columns (see ``near_duplicates``)."""
    (rid,) = own_name(docs, "rid")
    numbered = Folder(docs.sparkSession, "simhash").numbered(docs, rid)
    rows = numbered.select(F.col(rid).alias("rid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    gone = near_duplicates(rows, shingle=shingle, radius=radius).where("rid <> keep_rid").select(F.col("rid").alias(rid))
    return numbered.join(gone, rid, "left_anti").select(*docs.columns)
