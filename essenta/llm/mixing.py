"""Mixing sources to target weights by entropy balancing, with DataFrame functions alone.

Among all document rates in [0, 3] that give every source its target number of words, the
solution closest in relative entropy to "each document once" is an exponential tilt,
``rate = min(3, exp(lambda * size))`` with one dual variable per source. Newton steps on the
convex dual find the variables; a bracket catches a step that leaves it. All sources step
together. The sums of a step run over the histogram (source, size, documents), which is
what the rates depend on, so a step costs the distinct sizes and not the documents.

Rates become whole copies by systematic rounding along the sizes of a source, largest
first: the copies up to each size are the rounded sum of the rates up to it, so the words
taken differ from the target by less than one long document. Of ``OFFSETS`` roundings of
a source the one nearest to its target is used, and one more copy is added or left out
where that comes nearer still.

Documents of equal size are interchangeable: who gets the odd copy is decided by a hash
bucket and the id inside the bucket, with exact quotas per bucket, so no size or source is
ever ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from essenta.llm.common import WORD, Folder, own_name
from essenta.operators.order import position

MOST, OFFSETS, ROUNDS, BUCKET_ROWS = 3.0, 64, 200, 20_000


def text_size(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame) -> DataFrame:
    """Add ``sid`` and ``target`` to one row per source ``(source, source_size)``.

    Sources in code point order, null last, weigh 1, 2, 3, repeating. Shares of the total
    size follow the weights; a target stops at three times its source's size and the rest
    shares the excess by weight until none is above.
    """
    ranked = position(
        sources.withColumn("_null", F.col("source").isNull()), [], ["_null", "source"], "sid").drop("_null").withColumn(
        "weight", ((F.col("sid") - 1) % 3 + 1).cast("double")).withColumn("most", MOST * F.col("source_size"))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0  # words per unit of weight; it only rises, and each rise closes a source
    while True:
        above = F.col("weight") * level >= F.col("most")
        closed, weight = ranked.agg(
            F.sum(F.when(above, F.col("most")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        raised = (total - closed) / weight if weight else level
        if raised <= level * (1 + 1e-12):
            break
        level = raised
    return ranked.withColumn("target", F.least(F.col("weight") * level, F.col("most")))


def _tilt(hist: DataFrame, targets: DataFrame, folder: Folder) -> DataFrame:
    """``sid, lam``: the dual variable of each source, null where the rate is 3 throughout."""
    ends = hist.where("size > 0").groupBy("sid").agg(
        F.min("size").alias("least_size"), (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    state = targets.join(ends, "sid").where(F.col("target") < F.col("most") * (1 - 1e-12)).select(
        "sid", "scale", F.col("target") / F.col("scale"),
        F.lit(0.0).alias("lam"),
        (-F.log(MOST * F.col("source_size") / F.col("target") * MOST) * F.col("scale") / F.col("least_size")).alias("low"),
        (F.log(F.lit(MOST)) * F.col("scale") / F.col("least_size")).alias("high"),
        F.lit(False).alias("settled")).toDF("sid", "scale", "goal", "lam", "low", "high", "settled")
    state = folder.write(state, "dual0")
    for turn in range(1, ROUNDS + 1):
        if state.where("not settled").isEmpty():
            break
        x = F.col("size") / F.col("scale")
        rate = F.exp(F.least(F.col("lam") * x, F.log(F.lit(MOST))))
        sums = hist.join(state.where("not settled"), "sid").groupBy("sid").agg(
            F.sum(F.col("n") * x * rate).alias("words"),
            F.sum(F.when(rate < MOST * (1 - 1e-12), F.col("n") * x * x * rate).otherwise(0.0)).alias("slope"))
        gap = F.col("words") - F.col("goal")
        low = F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        # on the logarithm of the words: nearly linear in lambda, so a handful of steps is enough from anywhere
        newton = F.col("lam") - F.log(F.col("words") / F.col("goal")) * F.col("words") / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > low) & (newton < high)
        step = F.when(inside, newton).otherwise((low + high) / 2)
        settled = (F.abs(gap) <= 1e-9 * F.col("goal")) | (high - low <= 1e-13 * (F.abs(low) + F.abs(high)))
        moved = state.join(sums, "sid", "left").select(
            "sid", "scale", "goal",
            F.when(F.col("settled") | F.coalesce(settled, F.lit(True)), F.col("lam")).otherwise(step).alias("lam"),
            F.when(F.col("settled"), F.col("low")).otherwise(low).alias("low"),
            F.when(F.col("settled"), F.col("high")).otherwise(high).alias("high"),
            (F.col("settled") | F.coalesce(settled, F.lit(True))).alias("settled"))
        state = folder.write(moved, f"dual{turn}")
        folder.drop(f"dual{turn - 1}")
    return state.select("sid", (F.col("lam") / F.col("scale")).alias("lam"))


def _copies_by_size(hist: DataFrame, targets: DataFrame, lam: DataFrame) -> DataFrame:
    """``sid, size, n, copies``: whole copies for all documents of a source and size together."""
    full = targets.join(lam, "sid", "left").select("sid", "target", "lam")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("lam").isNull(), MOST).otherwise(
        F.exp(F.least(F.col("lam") * F.col("size"), F.log(F.lit(MOST)))))
    sizes = Window.partitionBy("sid").orderBy(F.col("size").desc())
    upto = hist.join(full, "sid").withColumn("due", F.col("n") * rate).withColumn(
        "upto", F.sum("due").over(sizes.rowsBetween(Window.unboundedPreceding, 0)))
    whole = lambda off: F.floor(F.col("upto") + off + 1e-9) - F.floor(F.col("upto") - F.col("due") + off + 1e-9)
    offset = F.col("k") / F.lit(float(OFFSETS))
    best = upto.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(OFFSETS - 1)))).groupBy("sid", "k").agg(
        F.abs(F.sum(whole(offset) * F.col("size")) - F.first("target")).alias("miss")
    ).groupBy("sid").agg(F.min(F.struct("miss", "k")).alias("b")).select("sid", F.col("b.k").alias("k"))
    chosen = upto.join(best, "sid").select("sid", "size", "n", "target", whole(offset).cast("long").alias("copies"))
    # last, one copy of one size more or less where that comes nearer
    off = chosen.groupBy("sid").agg((F.sum(F.col("copies") * F.col("size")) - F.first("target")).alias("off"))
    copies = F.col("copies") + F.col("change")
    mend = chosen.join(off, "sid").withColumn("change", F.explode(F.array(F.lit(-1), F.lit(1)))).where(
        copies.between(F.lit(0), MOST * F.col("n"))).withColumn("miss", F.abs(F.col("off") + F.col("change") * F.col("size")))
    mend = mend.where(F.col("miss") < F.abs("off")).groupBy("sid").agg(F.min(F.struct("miss", "size", "change")).alias("b")).select(
        "sid", F.col("b.size").alias("size"), F.col("b.change").alias("change"))
    return chosen.join(mend, ["sid", "size"], "left").select(
        "sid", "size", "n", (F.col("copies") + F.coalesce("change", F.lit(0))).alias("copies"))


def mix_sources(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (0 to 3) per row.

    A null text has size 0, a null source is a source of its own, a null id hashes like any
    value. Repeated rows are separate documents. Rows of size 0 are taken once. No rows give
    no rows. Reruns agree: nothing depends on partitions or task order. The four new columns
    get a trailing underscore if ``docs`` has the name already.
    """
    folder = Folder(docs.sparkSession, "mixing")
    size, source_size, target, copies = own_name(docs, "size", "source_size", "target", "copies")
    measured = folder.write(
        docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), text_size(F.col(text)).alias("size")), "sizes")
    n = measured.count()
    sources = folder.write(measured.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    targets = folder.write(source_targets(sources), "targets")
    buckets = max(1, -(-n // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
    same = measured.withColumnRenamed("source", "src").join(
        targets.select("sid", F.col("source").alias("s")), F.col("src").eqNullSafe(F.col("s")))
    parts = folder.write(same.withColumn("bucket", bucket).groupBy("sid", "size", "bucket").agg(
        F.count(F.lit(1)).alias("m")), "parts")
    hist = folder.write(parts.groupBy("sid", "size").agg(F.sum("m").alias("n")), "histogram")
    whole = _copies_by_size(hist, targets, _tilt(hist, targets, folder))
    # quotas: `each` copies for everyone, one more for `odd` of the n documents, spread over the buckets
    upto = F.sum("m").over(Window.partitionBy("sid", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    share = lambda rows: F.expr(f"cast(cast(odd as decimal(20,0)) * ({rows}) div n as long)")
    quotas = folder.write(
        parts.withColumn("upto", upto).join(whole, ["sid", "size"])
        .withColumn("each", F.expr("copies div n")).withColumn("odd", F.expr("copies % n"))
        .select("sid", "size", "bucket", "each", (share("upto") - share("upto - m")).alias("more")), "quotas")
    known = targets.select(F.col("source").alias("s"), "sid", F.col("source_size").alias("ss"), F.col("target").alias("tt"))
    return _with_copies(docs, text, doc_id, source, known, quotas, bucket_count=buckets, out=(size, source_size, target, copies))


def _with_copies(docs, text, doc_id, source, known, quotas, bucket_count, out) -> DataFrame:
    names = own_name(docs, *out, "sid", "bucket", "rank", "s", "ss", "tt", "each", "more", "mark")
    size, source_size, target, copies, sid, bucket, rank, s, ss, tt, each, more, mark = names
    rows = docs.withColumn(size, text_size(F.col(text))).withColumn(
        bucket, F.pmod(F.xxhash64(F.col(doc_id)), F.lit(bucket_count)).cast("int")).withColumn(mark, F.xxhash64(F.col(text)))
    k = known.toDF(s, sid, ss, tt)
    rows = rows.join(k, F.col(source).eqNullSafe(F.col(s)))
    q = quotas.select(F.col("sid").alias(f"{sid}q"), F.col("size").alias(f"{size}q"), F.col("bucket").alias(f"{bucket}q"),
                      F.col("each").alias(each), F.col("more").alias(more))
    rows = rows.join(q, (F.col(sid) == F.col(f"{sid}q")) & (F.col(size) == F.col(f"{size}q")) & (F.col(bucket) == F.col(f"{bucket}q")))
    order = Window.partitionBy(sid, size, bucket).orderBy(doc_id, mark)
    return rows.withColumn(rank, F.row_number().over(order)).select(
        *docs.columns, size, F.col(ss).alias(source_size), F.col(tt).alias(target),
        (F.col(each) + (F.col(rank) <= F.col(more)).cast("long")).alias(copies))


def mixture(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix_sources`` gives it copies."""
    (size, *_, copies) = own_name(docs, "size", "source_size", "target", "copies")
    mixed = mix_sources(docs, text, doc_id, source)
    (turn,) = own_name(mixed, "turn")
    return mixed.where(F.col(copies) > 0).withColumn(
        turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)
