"""Exact duplicates by a distributed MSD radix partition.

All documents start in one group. Every round splits each open group by the next bytes
of its texts: a count per (group, bytes), summed in the map tasks first, tells which
parts are single (nothing equals that text), which have ended (all bytes seen, so the
members are equal) and which stay open with the bytes they have left. Texts are compared
byte by byte; the SHA-256 is an output column and takes no part in the grouping.

The pieces grow by a factor of eight up to one megabyte, so the number of rounds follows
the logarithm of the longest text that has a twin. Only the first bytes of a text without
a twin are ever shuffled. A group is never gathered: sizes and winners are partial
aggregates, members find their group by a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from essenta.llm.common import Folder, ascii_lower, own_name

FIRST, GROWTH, LARGEST = 64, 8, 1 << 20


def radix_groups(rows: DataFrame, folder: Folder) -> DataFrame:
    """Group ``rows (rid, doc_id, b, sha)`` by equal bytes ``b``; ``rid`` is unique.

    Returns ``rid, doc_id, keep_rid, keep_id, group_size, sha`` for every row. The row
    with the largest ``(doc_id, rid)`` is the one to keep; a null doc_id is the smallest.
    """
    step, done = FIRST, []
    cut = lambda rest, n: [F.substring(rest, 1, n).alias("head"), F.expr(f"substring({rest}, {n + 1})").alias("rest")]
    open_rows = rows.select("rid", "doc_id", "sha", F.lit(0).cast("long").alias("gid"), *cut("b", step))
    for turn in range(1, 1 << 30):
        parts = folder.write(
            open_rows.groupBy("gid", "head").agg(
                F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "rid")).alias("top"), F.first("sha").alias("sha")),
            f"parts{turn}")
        single = parts.where("n = 1").select(
            F.col("top.rid").alias("rid"), F.col("top.doc_id").alias("doc_id"), F.col("top.rid").alias("keep_rid"),
            F.col("top.doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
        many = parts.where("n > 1").select("gid", "head", "n", "top")
        members = open_rows.join(many, ["gid", "head"]).select(
            "rid", "doc_id", "sha", F.col("top.rid").alias("gid"), F.col("top.doc_id").alias("keep_id"), "n",
            (F.octet_length("head") < step).cast("int").alias("ended"), "rest")
        split = folder.write(members.withColumn("rest", F.when(F.col("ended") == 0, F.col("rest"))), f"split{turn}", ["ended"])
        done += [single, split.where("ended = 1").select(
            "rid", "doc_id", F.col("gid").alias("keep_rid"), "keep_id", F.col("n").alias("group_size"), "sha")]
        if turn > 1:
            folder.drop(f"split{turn - 1}/ended=0")
        left = split.where("ended = 0")
        if left.isEmpty():
            break
        step = min(step * GROWTH, LARGEST)
        open_rows = left.select("rid", "doc_id", "sha", "gid", *cut("rest", step))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Two texts are equal when they are identical after lower-casing A-Z; a null text counts
    as empty. Of equal texts the row with the largest id stays. Repeated rows (same id and
    text) are members of the same group and exactly one of them stays; a null id is smaller
    than any other. Empty input gives an empty result. Other columns are not read.
    """
    folder = Folder(docs.sparkSession, "exact")
    rows = folder.write(
        docs.select(
            F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"),
            F.encode(ascii_lower(F.coalesce(F.col(text), F.lit(""))), "UTF-8").alias("b"),
        ).withColumn("sha", F.unhex(F.sha2("b", 256))), "rows")
    groups = radix_groups(rows, folder)
    folder.drop("rows")
    return groups.select(
        "doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (see ``exact_duplicates``)."""
    (rid,) = own_name(docs, "rid")
    folder = Folder(docs.sparkSession, "exact")
    numbered = folder.numbered(docs, rid)
    rows = numbered.select(
        F.col(rid).alias("rid"), F.col(doc_id).alias("doc_id"),
        F.encode(ascii_lower(F.coalesce(F.col(text), F.lit(""))), "UTF-8").alias("b"),
    ).withColumn("sha", F.unhex(F.sha2("b", 256)))
    gone = radix_groups(rows, folder).where("rid <> keep_rid").select(F.col("rid").alias(rid))
    return numbered.join(gone, rid, "left_anti").select(*docs.columns)
