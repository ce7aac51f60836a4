"""Files read in blocks of lines: the same records as from whole documents, whatever lies between the blocks."""

import random

import pytest
from pyspark.sql import functions as F

from sheaf.functions import text as X
from sheaf.operators.decode import Decoder
from sheaf.operators.encode import Encoder
from sheaf.options import DecodeOptions, EncodeOptions
from sheaf.sources import files, scan

PIECES = ['a', ',', '"', '""', '\n', '\r', '\r\n', '"x\ny"', ' ', 'é', '﻿', ',"', '",', '\n\n']


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return ["", "\n", "\r", "a\n\n", "a\n\r", '"a', '"a\n', 'a,b\n"c\n\nd",e\n\n', "﻿\"a\nb\",c\n", "a\rb\nc", *("".join(rng.choices(PIECES, k=rng.randint(1, 40))) for _ in range(60))]


@pytest.mark.parametrize("block", ["4m", "16b"])
def test_files_like_documents(spark, tmp_path, texts, block):
    for i, text in enumerate(texts):
        (tmp_path / f"f{i:03d}.csv").write_bytes(text.encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        name = F.element_at(F.split("src", "/"), -1)
        ours = [p.records.withColumn("src", name) for p in files.parts(spark, str(tmp_path), headers=False)]
        got = {}
        for records in ours:
            for r in records.collect():
                got.setdefault(r.src, []).append((r.row, r.raw, tuple(r.fields), r.closed))
        docs = scan.documents(spark, str(tmp_path)).withColumn("src", name)
        expected = {}
        for r in scan.records(docs).collect():
            expected.setdefault(r.src, []).append((r.row, r.raw, tuple(r.fields), r.closed))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert set(got) == set(expected)
    for src in expected:
        assert sorted(got[src]) == sorted(expected[src]), texts[int(src[1:4])]


def test_no_file_in_one_row(spark, tmp_path):
    """The rows of the exact tier hold lines, not files, where each line is a record."""
    (tmp_path / "a.csv").write_text("a,b\n" + '1,"x, y"\n' * 10_000)
    plan = Decoder().read(spark, str(tmp_path), "a long not null, b string not null")._jdf.queryExecution().toString()
    assert "binaryFile" not in plan and "Exchange hashpartitioning" not in plan
    assert Decoder().read(spark, str(tmp_path), "a long not null, b string not null").count() == 10_000


def test_rows_number_over_blocks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n" + "".join(f'{i},"t{i}"\n' for i in range(2000)) + "x,y\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        bad = Decoder(DecodeOptions(on_error="permissive")).read(spark, str(tmp_path), "a long not null, b string not null", keep_row=True)
        rows = [(r._row, r.a, len(r._errors)) for r in bad.orderBy("_row").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert rows == [(i + 2, i, 0) for i in range(2000)] + [(2002, None, 1)]


def test_quoted_without_expressions(spark):
    """The plain test gives what the regular expression gives."""
    texts = ["", " a ", "\ta\xa0", "a \n", " a \r", "a \r\n", " 　x  ", "  ", "a​b ", "᠎a ", " \n", "a,b", 'a"b', "a\rb", "é "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", X.needs_quoting(F.col("t")).alias("q"), F.col("t").rlike('[,"\\r\\n]').alias("p")).collect():
        assert r.q == r.p, repr(r.t)


def test_written_numbers_need_no_quotes_but_where_the_delimiter_is_in_them(spark):
    rows = spark.createDataFrame([(-1, -2.5, "a-b")], "a long, b double, c string")
    for delimiter, expected in ((",", "-1,-2.5,a-b"), ("-", '"-1"-"-2.5"-"a-b"')):
        encoder = Encoder(EncodeOptions(delimiter=delimiter))
        assert encoder.to_string(rows).splitlines()[1] == expected
