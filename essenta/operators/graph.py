"""Network operators on edge tables, as joins and grouped sums.

An undirected graph is a table ``(src, dst, weight)`` with one row per edge; ``both_ways``
stores both directions. Loops keep their state in a reliable checkpoint per round, and
all seed sets, sources or terminal samples move together as a key of the same table. A hub
with a third of all edges is one skewed join key, which adaptive execution splits, and
all per-node sums combine map-side.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from essenta.operators.order import _MAX_RANGES, attach, group_sizes, position, top_rows
from essenta.operators.topk import feature_set
from essenta.session import bounded_broadcast, cut, drop_cut, drop_path, drop_shuffles, scratch_path, split_rows

_SETS = 32  # seed sets that walk together
_FEWEST_SETS = 8  # sources of betweenness that move together on a graph of any size
_SET_VALUES = 64_000_000  # nodes x sources that move together on a large graph
_MOVED = 4_000_000  # values written after which shuffle files are deleted
_MAX_PARTS = 8192
_MAX_HUBS = 4096  # nodes whose rows are broadcast
_HUB_DEGREE = 100


def both_ways(edges: DataFrame, weight: str | None = "weight", merge: str = "min") -> DataFrame:
    """Both directions of every edge; loops go.

    Parallel edges keep the smallest weight (lengths) or, with ``merge="sum"``, add up
    (strengths). Without a weight column every edge counts 1.
    """
    size = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    forward = edges.select("src", "dst", size.alias("weight"))
    backward = forward.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return forward.unionByName(backward).where("src <> dst").groupBy("src", "dst").agg(
        (F.sum if merge == "sum" else F.min)("weight").alias("weight"))


def lengths(edges: DataFrame, weight: str | None = "weight") -> DataFrame:
    """Both directions with lengths; a length that is not positive is an error (paths would not end)."""
    moves = cut(both_ways(edges, weight))
    if not moves.where("weight IS NULL OR isnan(weight) OR weight <= 0").isEmpty():
        raise ValueError("edge lengths must be positive")
    return moves


class HeldEdges:
    """Edges partitioned once by source and kept, so a round only moves the node state.

    The edges of a hub above the split size go to several slots, and the state row of that
    hub is sent to each of them. At most 65,536 hubs can exceed the split size, so their
    table is broadcast. ``width``: state rows per node (groups), each of which meets all edges of
    its node: slots and partitions are that much smaller.
    """

    def __init__(self, moves: DataFrame, width: int = 1):
        largest, total = group_sizes(moves, ["src"])
        most = max(1, split_rows(moves.sparkSession) // max(1, width))
        goal = max(most, -(-total // _MAX_RANGES))
        parts = max(int(moves.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(_MAX_PARTS, -(-total // most)))
        self.hubs = None
        if largest <= goal:
            self.table = moves.repartition(parts, "src").sortWithinPartitions("src").persist()
        else:
            hubs = moves.groupBy("src").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > goal)
            self.hubs = cut(hubs.select("src", F.ceil(F.col("_n") / goal).cast("int").alias("_slots")))
            slot = F.pmod(F.xxhash64("dst"), F.coalesce("_slots", F.lit(1))).cast("int")
            placed = moves.join(F.broadcast(self.hubs), "src", "left").withColumn("_slot", slot).drop("_slots")
            self.table = placed.repartition(parts, "src", "_slot").persist()
        self.table.count()

    def join(self, state: DataFrame) -> DataFrame:
        """State rows ``(node, ...)`` with the edges that leave their node (``src``, ``dst``)."""
        sent = state.withColumn("src", F.col("node"))
        if self.hubs is None:
            return sent.join(self.table, "src")
        slots = F.sequence(F.lit(0), F.coalesce("_slots", F.lit(1)) - 1)
        sent = sent.join(F.broadcast(self.hubs), "src", "left").withColumn("_slot", F.explode(slots)).drop("_slots")
        return sent.join(self.table, ["src", "_slot"]).drop("_slot")

    def release(self) -> None:
        self.table.unpersist()


class SharedEdges:
    """Edges without lengths, held once for rounds of sums over neighbours that move little.

    An edge is held at both ends, partitioned by ``src``; one between a hub and another node only at
    the latter. What a hub sends is broadcast to its edges, and tasks add up what it receives before
    that is moved, so neither is a row per edge. There are at most ``_MAX_HUBS`` hubs.
    ``pairs``: (a, b), one row per edge.
    """

    def __init__(self, pairs: DataFrame):
        total = pairs.count()
        degrees = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("_n"))
        self.hubs = cut(degrees.where(F.col("_n") > max(_HUB_DEGREE, 2 * total // _MAX_HUBS)).select("node"))
        sides = pairs
        for end in ("a", "b"):
            hub = F.broadcast(self.hubs.select(F.col("node").alias(end), F.lit(True).alias(f"_{end}")))
            sides = sides.join(hub, end, "left")
        at_a = sides.where("_a IS NULL OR _b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        at_b = sides.where("_b IS NULL OR _a").select(F.col("b").alias("src"), F.col("a").alias("dst"))
        spark = pairs.sparkSession
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(_MAX_PARTS, -(-4 * total // split_rows(spark))))
        self.table = at_a.unionByName(at_b).repartition(parts, "src").sortWithinPartitions("src").persist()
        self.table.count()

    def nodes(self) -> DataFrame:
        return self.table.select(F.col("src").alias("node")).unionByName(self.hubs).distinct()

    def sent(self, state: DataFrame) -> DataFrame:
        """State rows ``(node, ...)`` as they arrive at the neighbours of their node, to be added up by ``node``."""
        given = [c for c in state.columns if c != "node"]
        hubs = F.broadcast(self.hubs)
        rest = state.join(hubs, "node", "left_anti").withColumnRenamed("node", "src")
        most = state.join(hubs, "node", "left_semi").withColumnRenamed("node", "dst")
        pushed = rest.join(self.table, "src").select(F.col("dst").alias("node"), *given)
        return pushed.unionByName(self.table.join(F.broadcast(most), "dst").select(F.col("src").alias("node"), *given))

    def release(self) -> None:
        self.table.unpersist()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges, None).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def neighbours(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Neighbours of a node set, ``(node, neighbour)``."""
    wanted = names.select(F.col("node").alias("src")).distinct()
    return both_ways(edges, None).join(wanted, "src", "left_semi").select(
        F.col("src").alias("node"), F.col("dst").alias("neighbour"))


def random_walk(
    edges: DataFrame, hubs: DataFrame, restart: float = 0.4, strength: str = "weight", tol: float = 1e-9,
    max_iter: int = 1000, zeros: bool = True, per_pass: int = _SETS,
) -> DataFrame:
    """Random walk with restart from hub nodes: ``(seed_set, node, probability)``.

    ``hubs``: (seed_set, node). Weights are strengths, normalised per node; a node without
    edges passes nothing on. A seed set with no hub in the graph is an error. The walk of a set
    stops at the first step whose L1 change is below ``tol`` and returns the iterate before
    it. Parallel edges add up. Nodes that a set never reaches have probability 0;
    without ``zeros`` they have no row, which many seed sets on a large graph call for. A walk
    that has not settled after ``max_iter`` steps warns.

    ``per_pass`` sets walk together as columns of one row per node. Edges and state are
    hashed by node alike, so a step is one exchange, the sum of what arrives at a node; the
    former iterate of each step is deleted.
    """
    moves = both_ways(edges, strength, "sum")
    every = nodes(edges)
    out = moves.groupBy("src").agg(F.sum("weight").alias("_total"))
    held = HeldEdges(cut(moves.join(out, "src").where("_total > 0").select(
        "src", "dst", (F.col("weight") / F.col("_total")).alias("_t"))))
    sets = hubs.select("seed_set", "node").distinct()
    found = sets.join(every, "node", "left_semi")
    if sets.join(found.select("seed_set").distinct(), "seed_set", "left_anti").limit(1).count():
        raise ValueError("a seed set has no node in the graph")
    sizes = found.groupBy("seed_set").agg(F.count(F.lit(1)).alias("_k"))
    numbered = cut(position(sizes, [], ["seed_set"], "_i"))
    start = cut(found.join(numbered, "seed_set").select("_i", "node", (1 / F.col("_k")).alias("p")))
    folder, late = scratch_path(edges.sparkSession, "walk"), 0
    n = numbered.count()
    for first in range(0, n, per_pass):
        width = min(per_pass, n - first)
        names = [f"_p{k}" for k in range(width)]
        mine = start.where(F.col("_i").between(first + 1, first + width))
        state = cut(mine.groupBy("node").agg(*[
            F.sum(F.when(F.col("_i") == first + 1 + k, F.col("p")).otherwise(0.0)).alias(c) for k, c in enumerate(names)]))
        walked, steps = _walk(held, state, names, restart, tol, max_iter)
        late = max(late, steps)
        walked.select("node", F.explode(F.array(*[
            F.struct(F.lit(first + 1 + k).cast("long").alias("_i"), F.col(c).alias("probability")) for k, c in enumerate(names)])).alias("e")).select(
            "node", "e.*").where("probability > 0").write.parquet(f"{folder}/pass={first}")
        drop_cut(walked)
    held.release()
    if late > max_iter:
        warnings.warn(f"the walk has not settled after {max_iter} steps", RuntimeWarning, stacklevel=2)
    rows = edges.sparkSession.read.schema(f"node {every.schema['node'].dataType.simpleString()}, _i long, probability double").parquet(folder)
    p = rows.join(numbered.select("_i", "seed_set"), "_i").select("seed_set", "node", "probability")
    return p.unionByName(_unreached(sets, every, p)) if zeros else p


def _walk(held: HeldEdges, state: DataFrame, names: list[str], restart: float, tol: float, max_iter: int) -> tuple[DataFrame, int]:
    """The settled iterates of one pass, and the number of steps (above ``max_iter``: not settled)."""
    # the steps are stated as text: one call each instead of one per column
    home = cut(state.selectExpr("node", *[f"{c} * {restart!r}D AS {c}" for c in names]))
    onward = ["dst AS node", *[f"{c} * _t * {1 - restart!r}D AS {c}" for c in names]]
    arrived = [F.expr(f"sum({c}) AS {c}") for c in names]
    former = ["node AS _at", *[f"{c} AS _o{c}" for c in names]]
    change_of = [F.expr(f"sum(abs({c} - _o{c})) AS {c}") for c in names]
    same = F.expr("node = _at")
    settled, stored = [False] * len(names), state
    for done in range(1, max_iter + 1):
        new = held.join(state).selectExpr(*onward).unionByName(home).groupBy("node").agg(*arrived)
        pairs = [x for still, c in zip(settled, names) for x in (
            f"coalesce({f'_o{c}' if still else c}, 0D) AS {c}", f"coalesce(_o{c}, 0D) AS _o{c}")]
        seen = Observation()
        both = new.join(state.selectExpr(*former), same, "full").selectExpr("coalesce(node, _at) AS node", *pairs)
        after = cut(both.observe(seen, *change_of))
        change = seen.get
        drop_cut(stored)
        stored = after
        settled = [s or change[c] < tol for s, c in zip(settled, names)]
        # a set that settles at this step goes back to the iterate before it
        state = after.selectExpr("node", *[f"{f'_o{c}' if s else c} AS {c}" for s, c in zip(settled, names)])
        if all(settled):
            break
    else:
        done = max_iter + 1
    out = cut(state)
    drop_cut(stored)
    drop_cut(home)
    return out, done


def _unreached(sets: DataFrame, every: DataFrame, p: DataFrame) -> DataFrame:
    """Nodes a set never reached, with probability 0."""
    lost = every.join(p.groupBy("node").agg(F.count(F.lit(1)).alias("_k")), "node", "left")
    n = sets.select("seed_set").distinct().count()
    lost = lost.where(F.coalesce("_k", F.lit(0)) < n).select("node", F.explode(F.sequence(F.lit(1), F.lit(n).cast("long"))).alias("_i"))
    named = position(sets.select("seed_set").distinct(), [], ["seed_set"], "_i")
    return lost.join(named, "_i").select("seed_set", "node").join(
        p.select("seed_set", "node"), ["seed_set", "node"], "left_anti").withColumn("probability", F.lit(0.0))


# Shortest paths -------------------------------------------------------------------


def hop_paths(edges: DataFrame, source: DataFrame) -> DataFrame:
    """Hop distance, number of shortest paths and one path ``a:b:c`` from every source.

    ``source``: (node). Returns ``(source, node, distance, n_paths, path)``; the path is the
    smallest by text. Edges go both ways, so what a level reaches is new or belongs to one of the
    two levels before: each level is written once and compared with these two only.
    """
    spark = edges.sparkSession
    held = HeldEdges(cut(both_ways(edges, None).select("src", "dst")))
    start = source.select("node").distinct().join(nodes(edges), "node", "left_semi").select(
        F.col("node").alias("source"), "node", F.lit(0).alias("distance"), F.lit(1.0).alias("n_paths"), F.col("node").alias("path"))
    folder, level = scratch_path(spark, "paths"), 0
    before, frontier, found = None, *_write_level(start, f"{folder}/level=0")
    while found:
        level += 1
        reach = held.join(frontier).groupBy("source", "dst").agg(
            (F.min("distance") + 1).cast("int").alias("distance"), F.sum("n_paths").alias("n_paths"),
            F.min(F.concat_ws(":", "path", "dst")).alias("path")).withColumnRenamed("dst", "node")
        last = frontier if before is None else frontier.unionByName(before)
        new = reach.join(last.select("source", "node"), ["source", "node"], "left_anti").select(*start.columns)
        before, (frontier, found) = frontier, _write_level(new, f"{folder}/level={level}")
    held.release()
    return spark.read.schema(start.schema).parquet(folder).select(*start.columns)


def _write_level(rows: DataFrame, path: str) -> tuple[DataFrame, int]:
    """The rows, stored, and their number."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path), seen.get["n"]


def within_distance(paths: DataFrame, most: int = 3) -> DataFrame:
    return paths.where(F.col("distance") <= most).select("source", "node", "distance")


def nodes_per_distance(paths: DataFrame) -> DataFrame:
    return paths.groupBy("source", "distance").agg(F.count(F.lit(1)).alias("n"))


def group_edges(edges: DataFrame, starts: DataFrame) -> HeldEdges:
    """The edges, kept for as many state rows per node as ``starts`` has groups."""
    return HeldEdges(edges, starts.select("grp").distinct().count())


def weighted_distances(edges: DataFrame, starts: DataFrame, held: HeldEdges | None = None) -> DataFrame:
    """Distance to the nearest start of each group: ``(grp, node, dist, root, pred)``.

    ``edges`` come from ``lengths``; ``starts``: (grp, node). Rounds of relaxation from the nodes that changed; ties go to
    the smaller root, then the smaller predecessor. ``held``: the edges, when the caller keeps them.
    """
    state = cut(starts.select(
        "grp", "node", F.lit(0.0).alias("dist"), F.col("node").alias("root"), F.lit(None).cast("string").alias("pred")))
    changed = stored = state
    mine = held is None
    held = group_edges(edges, state) if mine else held
    while True:
        offers = held.join(changed).select(
            "grp", F.col("dst").alias("node"), (F.col("dist") + F.col("weight")).alias("dist"), "root", F.col("node").alias("pred"))
        marked = state.withColumn("_new", F.lit(False)).unionByName(offers.withColumn("_new", F.lit(True)))
        # an offer must beat the present entry, so equal ones never flip
        best = marked.groupBy("grp", "node").agg(
            F.min(F.struct("dist", "root", F.col("_new"), F.coalesce("pred", F.lit("")).alias("pred"))).alias("_b"))
        after = cut(best.select("grp", "node", "_b.dist", "_b.root", F.nullif(F.col("_b.pred"), F.lit("")).alias("pred"),
                                F.col("_b._new").alias("_new")))
        drop_cut(stored)
        stored = after
        changed = after.where("_new").drop("_new")
        state = after.drop("_new")
        if changed.limit(1).count() == 0:
            if mine:
                held.release()
            return state


# Steiner subgraph -----------------------------------------------------------------


def sample_nodes(edges: DataFrame, names: DataFrame, n_iter: int, share: float = 0.7, seed: int = 42) -> DataFrame:
    """Seeded subsets of the names present in the graph: ``(grp, node)`` per iteration.

    Order by ``md5(node|iteration|seed)``, first ``floor(share * n)``.
    """
    present = names.select("node").distinct().join(nodes(edges), "node", "left_semi")
    size = present.agg(F.floor(F.count(F.lit(1)) * F.lit(float(share))).alias("_k"))
    drawn = present.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(n_iter - 1)))).withColumn(
        "_h", F.md5(F.concat_ws("|", "node", F.col("grp").cast("string"), F.lit(str(seed)))))
    placed = position(drawn, ["grp"], ["_h", "node"], "_pos")
    return attach(placed, size).where(F.col("_pos") <= F.col("_k")).select("grp", "node")


def spanning_edges(links: DataFrame) -> DataFrame:
    """Minimum spanning forest per group by merging components: rows ``(grp, a, b, length)``.

    Each round every component picks its smallest outgoing link (ties by name, so no cycle
    can form), and chains of picks are followed by pointer doubling.
    """
    links = cut(links)
    comp = cut(links.select("grp", F.col("a").alias("node")).unionByName(
        links.select("grp", F.col("b").alias("node"))).distinct().withColumn("comp", F.col("node")))
    chosen = None
    while True:
        ca = comp.select("grp", F.col("node").alias("a"), F.col("comp").alias("ca"))
        cb = comp.select("grp", F.col("node").alias("b"), F.col("comp").alias("cb"))
        open_links = links.join(ca, ["grp", "a"]).join(cb, ["grp", "b"]).where("ca <> cb")
        ends = F.explode(F.array(F.struct(F.col("ca").alias("me"), F.col("cb").alias("other")),
                                 F.struct(F.col("cb").alias("me"), F.col("ca").alias("other")))).alias("e")
        picks = cut(open_links.select("grp", "a", "b", "length", ends).groupBy("grp", F.col("e.me").alias("me")).agg(
            F.min(F.struct("length", "a", "b", F.col("e.other").alias("other"))).alias("p")))
        if picks.limit(1).count() == 0:
            return chosen if chosen is not None else links.limit(0)
        new = picks.select("grp", "p.a", "p.b", "p.length").distinct()
        chosen = cut(new if chosen is None else chosen.unionByName(new).distinct())
        # two components that pick the same link point at each other: the smaller name is the root
        to = picks.select("grp", "me", F.col("p.other").alias("up"))
        back = to.select("grp", F.col("me").alias("up"), F.col("up").alias("_upup"))
        parent = cut(to.join(back, ["grp", "up"], "left").select(
            "grp", "me", F.when((F.col("_upup") == F.col("me")) & (F.col("me") < F.col("up")), F.col("me")).otherwise(F.col("up")).alias("up")))
        while True:
            over = parent.select("grp", F.col("me").alias("up"), F.col("up").alias("_next"))
            jumped = cut(parent.join(over, ["grp", "up"], "left").select(
                "grp", "me", F.coalesce("_next", "up").alias("up"), (F.coalesce("_next", "up") != F.col("up")).alias("_moved")))
            parent = jumped.drop("_moved")
            if jumped.where("_moved").limit(1).count() == 0:
                break
        comp = cut(comp.join(parent.select("grp", F.col("me").alias("comp"), "up"), ["grp", "comp"], "left").select(
            "grp", "node", F.coalesce("up", "comp").alias("comp")))


def steiner_trees(edges: DataFrame, terminals: DataFrame, length: str = "weight") -> DataFrame:
    """A 2-approximate Steiner tree per group of terminals: ``(grp, src, dst)``.

    Every node belongs to its nearest terminal; the shortest link between two regions joins
    their terminals; a spanning forest of these links is expanded along the predecessors.
    Weights are lengths.
    """
    moves = lengths(edges, length)
    held = group_edges(moves, terminals)
    near = weighted_distances(moves, terminals, held)
    left = held.join(near.select("grp", "node", F.col("dist").alias("_du"), F.col("root").alias("a"))).drop("node")
    right = near.select("grp", F.col("node").alias("dst"), F.col("dist").alias("_dv"), F.col("root").alias("b"))
    border = left.where("src < dst").join(right, ["grp", "dst"]).where("a <> b").select(
        "grp", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
        (F.col("_du") + F.col("weight") + F.col("_dv")).alias("length"), "src", "dst")
    links = cut(border.groupBy("grp", "a", "b").agg(F.min(F.struct("length", "src", "dst")).alias("m")).select(
        "grp", "a", "b", "m.length", "m.src", "m.dst"))
    held.release()
    kept = links.join(spanning_edges(links.select("grp", "a", "b", "length")), ["grp", "a", "b", "length"], "left_semi")
    tree = cut(kept.select("grp", "src", "dst"))
    ends = F.explode(F.array("src", "dst")).alias("node")
    frontier = tree.select("grp", ends).distinct()
    while True:
        up = frontier.join(near.where("pred IS NOT NULL").select("grp", "node", "pred"), ["grp", "node"]).select(
            "grp", F.least("node", "pred").alias("src"), F.greatest("node", "pred").alias("dst"), F.col("pred").alias("node")).distinct()
        fresh = cut(up.join(tree, ["grp", "src", "dst"], "left_anti"))
        if fresh.limit(1).count() == 0:
            return tree
        tree = cut(tree.unionByName(fresh.select("grp", "src", "dst").distinct()))
        frontier = fresh.select("grp", "node").distinct()


def steiner_subgraph(
    edges: DataFrame, names: DataFrame, n_iter: int, share: float = 0.7, seed: int = 42, length: str = "weight"
) -> DataFrame:
    """Union of the trees over seeded samples of the names, with the edge weights."""
    drawn = cut(sample_nodes(edges, names, n_iter, share, seed))
    merged = steiner_trees(edges, drawn, length).select("src", "dst").distinct()
    return both_ways(edges, length).where("src < dst").join(merged, ["src", "dst"], "left_semi")


# Betweenness ----------------------------------------------------------------------


def subset_betweenness(edges: DataFrame, sources: DataFrame, targets: DataFrame, length: str | None = "weight") -> DataFrame:
    """Share of shortest paths between given sources and targets that run through a node.

    Scaled by 1 / ((n - 1)(n - 2)). Path counts run forward and dependencies run backward
    along the shortest-path edges, one hop per round, all sources together. Without lengths
    the edges on shortest paths are those between two levels, and no row per edge and source is made.
    """
    if length is None:
        return _hop_betweenness(edges, sources, targets)
    moves = lengths(edges, length)
    every = nodes(edges)
    n = every.count()
    starts = sources.select("node").distinct().join(every, "node", "left_semi").select(F.col("node").alias("grp"), "node")
    held = group_edges(moves, starts)
    dist = weighted_distances(moves, starts, held).select("grp", "node", "dist")
    tail = held.join(dist.select("grp", "node", F.col("dist").alias("_du"))).drop("node")
    head = dist.select("grp", F.col("node").alias("dst"), F.col("dist").alias("_dv"))
    dag = cut(tail.join(head, ["grp", "dst"]).where(
        F.col("_du") + F.col("weight") == F.col("_dv")).select("grp", "src", "dst"))
    held.release()
    drop_cut(moves)

    def rounds(first: DataFrame, move) -> DataFrame:
        """Sum over all hop counts of a linear step."""
        now = total = cut(first)
        while True:
            former, now = now, cut(move(now))
            if now.limit(1).count() == 0:
                summed = cut(total.groupBy("grp", "node").agg(F.sum("v").alias("v")))
                drop_cut(former)
                drop_cut(total)
                return summed
            before, total = total, cut(total.unionByName(now))
            drop_cut(former)
            drop_cut(before)

    def forward(now: DataFrame) -> DataFrame:
        return now.withColumnRenamed("node", "src").join(dag, ["grp", "src"]).groupBy(
            "grp", F.col("dst").alias("node")).agg(F.sum("v").alias("v"))

    paths = rounds(starts.withColumn("v", F.lit(1.0)), forward)
    up = paths.select("grp", F.col("node").alias("src"), F.col("v").alias("_su"))
    down = paths.select("grp", F.col("node").alias("dst"), F.col("v").alias("_sv"))
    shares = cut(dag.join(up, ["grp", "src"]).join(down, ["grp", "dst"]).select(
        "grp", "src", "dst", (F.col("_su") / F.col("_sv")).alias("_f")))
    drop_cut(dag)

    def backward(now: DataFrame) -> DataFrame:
        return now.withColumnRenamed("node", "dst").join(shares, ["grp", "dst"]).groupBy(
            "grp", F.col("src").alias("node")).agg(F.sum(F.col("v") * F.col("_f")).alias("v"))

    ends = dist.join(targets.select("node").distinct(), "node", "left_semi").select("grp", "node", F.lit(1.0).alias("v"))
    carried = rounds(ends, backward)
    drop_cut(shares)
    carried = carried.join(ends.select("grp", "node", F.lit(1.0).alias("_own")), ["grp", "node"], "left")
    passed = carried.where("grp <> node").select("node", (F.col("v") - F.coalesce("_own", F.lit(0.0))).alias("v"))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    summed = passed.groupBy("node").agg((F.sum("v") * scale).alias("betweenness"))
    return every.join(summed, "node", "left").select("node", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def _hop_betweenness(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """``subset_betweenness`` when every edge counts 1.

    A level has one row per node with a column per source, empty for sources that do not reach it there.
    Edges go both ways, so what a level reaches is new or belongs to one of the two levels before, and
    what it sends back counts where the level before has a number of paths. Levels are stored once; a pass
    of at most ``_SETS`` sources (fewer on a large graph) deletes its own.
    """
    spark = edges.sparkSession
    folder = scratch_path(spark, "between")
    rows = _write_level(edges.select("src", "dst"), f"{folder}/edges")[0]
    drop_shuffles(spark)
    pairs = _write_level(rows.where("src <> dst").select(
        F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), f"{folder}/pairs")[0]
    drop_shuffles(spark)
    held = SharedEdges(pairs)
    alone = nodes(rows.where("NOT coalesce(src <> dst, false)"))  # loops and missing ends count as nodes
    every, n = _write_level(held.nodes().unionByName(alone).distinct(), f"{folder}/nodes")
    drop_path(spark, f"{folder}/edges")
    starts = sources.select("node").distinct().join(every, "node", "left_semi")
    numbered = cut(position(starts, [], ["node"], "_i"))
    ends = bounded_broadcast(cut(targets.select("node").distinct().withColumn("_end", F.lit(True))))
    groups = numbered.count()
    most = max(_FEWEST_SETS, min(_SETS, _SET_VALUES // max(1, n)))
    width = -(-groups // max(1, -(-groups // most)))
    for first in range(0, groups, max(1, width)):
        names = [f"_p{k}" for k in range(min(width, groups - first))]
        start = numbered.where(F.col("_i").between(first + 1, first + len(names))).select(
            "node", *[F.when(F.col("_i") == first + 1 + k, F.lit(1.0)).alias(c) for k, c in enumerate(names)])
        at = f"{folder}/pass={first}"
        passed = _hop_flows(held, _hop_counts(held, start, names, f"{at}/counts"), ends, names, f"{at}/flows")
        passed.write.parquet(f"{folder}/passed/pass={first}")
        drop_path(spark, at)
    held.release()
    drop_path(spark, f"{folder}/pairs")
    if not groups:
        return every.select("node", F.lit(0.0).alias("betweenness"))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    summed = spark.read.schema(passed.schema).parquet(f"{folder}/passed").groupBy("node").agg((F.sum("v") * scale).alias("betweenness"))
    return every.join(summed, "node", "left").select("node", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def _hop_counts(held: SharedEdges, start: DataFrame, names: list[str], folder: str) -> list[DataFrame]:
    """Level by level the nodes reached and the number of shortest paths to them."""
    added = [F.expr(f"sum({c}) AS {c}") for c in names]
    # minus infinity marks the sources that have reached a node before: no sum with it is above 0
    known = ["node", *[f"if({c} IS NULL, NULL, double('-Infinity')) AS {c}" for c in names]]
    fresh = ["node", *[f"if({c} > 0 AND NOT isnan({c}), {c}, NULL) AS {c}" for c in names]]
    some = f"coalesce({', '.join(names)}) IS NOT NULL"
    levels, moved = [_write_level(start, f"{folder}/level=0")[0]], 0
    while True:
        reach = held.sent(levels[-1])
        for former in levels[-2:]:
            reach = reach.unionByName(former.selectExpr(*known))
        new = reach.groupBy("node").agg(*added).selectExpr(*fresh).where(some)
        level, found = _write_level(new, f"{folder}/level={len(levels)}")
        del reach, new
        moved += found * len(names)
        if moved > _MOVED:
            drop_shuffles(held.table.sparkSession)
            moved = 0
        if not found:
            return levels
        levels.append(level)


def _hop_flows(held: SharedEdges, levels: list[DataFrame], ends: DataFrame, names: list[str], folder: str) -> DataFrame:
    """What passes through the nodes, ``(node, v)``, from the farthest level back; the first is the sources themselves.

    A node sends back, for each source, its flow divided by its number of paths.
    """
    spark = held.table.sparkSession
    added = [F.expr(f"sum({c}) AS _in{c}") for c in names]
    sends = [f"CASE WHEN {c} IS NULL THEN NULL WHEN _end THEN 1 / {c} + coalesce(_in{c}, 0D) ELSE _in{c} END AS {c}" for c in names]
    passed = " + ".join(f"coalesce({c} * _in{c}, 0D)" for c in names)
    some = f"coalesce({', '.join(names)}) IS NOT NULL"
    later, moved = levels[0].limit(0), 0
    for at in range(len(levels) - 1, 0, -1):
        came = held.sent(later).groupBy("node").agg(*added)
        here = levels[at].join(ends, "node", "left").join(came, "node", "left")
        later, found = _write_level(here.selectExpr("node", *sends, f"{passed} AS v").where(some), f"{folder}/level={at}")
        later = later.drop("v")
        del came, here
        moved += found * len(names)
        if moved > _MOVED:
            drop_shuffles(spark)
            moved = 0
    if len(levels) == 1:
        return later.select("node", F.lit(0.0).alias("v"))
    kind = later.schema["node"].dataType.simpleString()
    return spark.read.schema(f"node {kind}, v double").parquet(folder).groupBy("node").agg(F.sum("v").alias("v"))


# Interaction tables ---------------------------------------------------------------


def confident_edges(interactions: DataFrame, score: float = 700, partners: int = 10) -> DataFrame:
    """Interactions at or above a score, at most ``partners`` per node by falling score."""
    strong = interactions.where(F.col("score") >= score)
    return top_rows(strong, ["src"], [F.desc("score"), F.col("dst")], partners).drop("rank")


def map_names(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Symbol to id through an alias table ``(alias, id, place)``; the last alias wins."""
    last = aliases.groupBy("alias").agg(F.max_by("id", F.struct("place", "id")).alias("id"))
    return names.join(last, F.col("name") == F.col("alias"), "left").select("name", "id")


def top_nodes(walk: DataFrame, pathway: DataFrame, k: int = 20) -> DataFrame:
    """The k most probable nodes per seed set, united with the pathway genes."""
    best = top_rows(walk, ["seed_set"], [F.desc("probability"), F.col("node")], k).select(
        "seed_set", F.col("node").alias("gene"))
    return feature_set(best, ["seed_set"], pathway)
