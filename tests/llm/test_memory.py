"""What the executors keep between the stages of a run."""

import ctypes
import re

import numpy as np
import pytest

from essenta.llm import kneser_ney as kn
from essenta.llm.common import FILE_BITS, Folder
from essenta.session import VECTORED_CONF


def anonymous_mb() -> float:
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", f.read()))) / 1024


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="not glibc")
def test_released_memory_goes_back_below_what_is_in_use():
    arrays = [np.ones(12_000) for _ in range(1_500)]  # too small for pages of their own
    full, last = anonymous_mb(), arrays[-1]
    del arrays
    kn.released()
    assert last.sum() == 12_000
    assert full - anonymous_mb() > 100


def test_row_numbers_start_no_python_workers(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(9).selectExpr("id as doc_id", "'t' as file").repartition(3).write.parquet(path)
    numbered = Folder(spark, "test").numbered(spark.read.parquet(path), "rid")
    assert "ExternalRDD" not in (plan := numbered._jdf.queryExecution().analyzed().toString()) and "LogicalRDD" not in plan
    assert sorted({r.rid >> FILE_BITS for r in numbered.collect()}) == [0, 1, 2]
    assert Folder(spark, "test").numbered(spark.read.parquet(path).where("doc_id < 0"), "rid").collect() == []


def test_row_numbers_of_no_files(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(0).selectExpr("id as doc_id").write.parquet(path)
    assert Folder(spark, "test").numbered(spark.read.parquet(path), "rid").collect() == []


def test_reads_are_plain_unless_the_session_says_otherwise(spark):
    before = spark.conf.get(VECTORED_CONF, None)
    try:
        for own, then in ((None, "false"), ("true", "true")):
            spark.conf.unset(VECTORED_CONF) if own is None else spark.conf.set(VECTORED_CONF, own)
            Folder(spark, "test")
            assert spark.conf.get(VECTORED_CONF) == then
    finally:
        spark.conf.unset(VECTORED_CONF) if before is None else spark.conf.set(VECTORED_CONF, before)
