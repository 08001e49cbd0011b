"""Odd documents that every operator must take, and small helpers."""

import glob
import os
import re

import duckdb

DIR = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 977}x{k % 89}" for k in range(30_000))
ODD = [
    (1, "The quick brown fox", "en", "a", 19), (1, "The quick brown fox", "en", "a", 19), (2, "THE QUICK brown FOX", "en", "b", 19),
    (None, "the quick brown fox", None, None, None), (3, None, "en", "a", None), (4, "", "de", None, 0), (None, None, None, None, None),
    (5, " \t\n ", "fr", "b", 4), (6, LONG, "en", "a", len(LONG)), (7, LONG + " tail", "en", "a", 5), (8, "É é ÀÀ İ ß", "fr", "c", 9),
    (9, "é É àà i̇ ß", "fr", "c", 9), (10, "a" * 50_000, "xx", "c", 50_000), (11, "x\x00y z 😀", "en", "a", 7),
]


def odd(spark, rows=ODD):
    return spark.createDataFrame(rows, COLUMNS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def table(spark, name):
    return spark.read.parquet(f"{DIR}/{name}.parquet")


def views():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con
