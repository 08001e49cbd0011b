import hashlib
import io
import zipfile
import zlib

import pytest

from essenta.llm import warc
from essenta.llm.warc import ARCHIVE, INDEX, PackageWriter, central_directory, parse_record, read_packages, write_packages
from tests.llm.odd import table, views

BIG = "<p>" + "ä text " * 60


def pages(spark):
    rows = [(5, "http://a.b/x y", BIG), (3, "http://a.b/2", BIG), (9, None, BIG), (None, "u", BIG), (1, "http://c/", "small"), (2, "http://c/", "small"),
            (4, "http://d/", None), (7, "", ""), (8, "http://e/\r\nX: y", "other" * 40), (8, "http://e/", "other" * 40), (10, "z", "x" * 300_000)]
    return spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, payload string, digest int")


def brute(rows):
    out = []
    for r in rows:
        data = (r.html or "").encode()
        same = [x.page_id for x in rows if (x.html or "").encode() == data and x.page_id is not None] if len(data) >= 100 else []
        first = min(same, default=None)
        revisit = first is not None and r.page_id != first
        out.append((r.page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def records(df):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()], key=repr)


@pytest.mark.parametrize("zip64,package,span", [(False, 1 << 28, 1 << 22), (True, 2000, 100)])
def test_round_trip(spark, tmp_path, zip64, package, span):
    docs = pages(spark)
    contents = write_packages(docs.repartition(2), str(tmp_path), zip64, package)
    got = read_packages(spark, str(tmp_path), range_bytes=span)
    assert records(got) == brute(docs.collect())
    assert contents.agg({"records": "sum"}).first()[0] == docs.count()
    kept = {r.payload_digest for r in got.collect() if r.payload is not None and hashlib.sha256(r.payload).hexdigest() == r.payload_digest}
    assert kept == {r[2] for r in brute(docs.collect())}


def test_table_equals_sql(spark, tmp_path):
    from essenta.llm.queries import ORACLE

    write_packages(table(spark, "pages"), str(tmp_path))
    assert records(read_packages(spark, str(tmp_path), with_payload=False)) == sorted(
        [tuple(None if x != x else x for x in r) for r in views().execute(ORACLE["op6_zip_archives"]).fetchall()], key=repr)


def test_reading_is_dealt_out(spark, tmp_path):
    docs = spark.range(200).selectExpr("id as page_id", "concat('http://a/', id) as url", "concat(id, repeat(md5(string(id)), 40)) as html")
    for name, package, span in [("many", 2000, 1 << 22), ("one", 1 << 28, 500)]:
        write_packages(docs.repartition(1), str(tmp_path / name), package_bytes=package)
        got = read_packages(spark, str(tmp_path / name), range_bytes=span)
        assert got.count() == 200
        assert got.select(warc.F.spark_partition_id()).distinct().count() > 4


def test_no_rows(spark, tmp_path):
    write_packages(pages(spark).limit(0), str(tmp_path))
    assert read_packages(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("zip64", [False, True])
def test_other_tools_read_the_packages(zip64):
    out = io.BytesIO()
    w = PackageWriter(out, zip64)
    for name, parts in ((ARCHIVE, [b"abc", b"defg"]), (INDEX, [b""])):
        w.begin(name)
        for p in parts:
            w.write(p)
        w.end()
    w.close()
    with zipfile.ZipFile(out) as z:
        assert z.testzip() is None and z.read(ARCHIVE) == b"abcdefg" and z.read(INDEX) == b""
    at, size, method = central_directory(out, len(out.getvalue()))[ARCHIVE]
    assert (out.getvalue()[at:at + size], method) == (b"abcdefg", 0)


def test_packages_of_other_tools_and_damage():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(INDEX, b"line")
        z.writestr(zipfile.ZipInfo(ARCHIVE), b"x" * 5000)
        z.comment = b"PK\x05\x06 comment"
    found = central_directory(out, len(out.getvalue()))
    assert out.getvalue()[found[ARCHIVE][0]:][:5000] == b"x" * 5000
    for bad in (b"", b"PK", out.getvalue()[:-30], b"\0" * 100):
        with pytest.raises(ValueError):
            central_directory(io.BytesIO(bad), len(bad))
    data = warc.record_bytes(1, "http://a", b"payload", "00", None, False)
    assert parse_record(zlib.decompress(warc.gzip_member(data), 31))["payload"] == b"payload"
    with pytest.raises(ValueError):
        parse_record(data[:-12])
