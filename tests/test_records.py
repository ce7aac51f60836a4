"""Records and fields: quotes, line ends, blank lines, byte order marks, strict mode."""

import csv
import io

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheaf.operators.decode import Decoder
from sheaf.operators.encode import Encoder
from sheaf.options import DecodeOptions, EncodeOptions
from sheaf.sources import scan

AB = "a string, b string"


def raw(spark, text, **options):
    docs = spark.createDataFrame([("0", text)], "src string, content string")
    rows = Decoder(DecodeOptions(**options)).raw(docs).orderBy("row").collect()
    return [list(r.fields) for r in rows]


CASES = [
    ("a,b\n1,2\n", [["a", "b"], ["1", "2"]]),
    ("a,b\r\n1,2\r\n", [["a", "b"], ["1", "2"]]),
    ("a,b\r1,2\r", [["a", "b"], ["1", "2"]]),
    ("a\nb\r\nc\rd", [["a"], ["b"], ["c"], ["d"]]),
    ('"x,y",z', [["x,y", "z"]]),
    ('"say ""hi""",z', [['say "hi"', "z"]]),
    ('"l1\r\nl2",z\n', [["l1\r\nl2", "z"]]),
    ('Hello"World,1', [['Hello"World', "1"]]),
    ("1,", [["1", ""]]),
    (",,", [["", "", ""]]),
    (",2,", [["", "2", ""]]),
    ("a\n\nb", [["a"], [""], ["b"]]),
    ("a\n\n", [["a"]]),
    ('a\n""', [["a"], [""]]),
    ('"abc"def,2', [["abc", "def", "2"]]),
    ("", []),
]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_split(spark, text, expected):
    assert raw(spark, text) == expected


def test_many_quotes_and_columns(spark):
    text = '"' + '""' * 20_000 + '"\n' + ",".join(["v"] * 5_000)
    rows = raw(spark, text)
    assert rows[0] == ['"' * 20_000] and len(rows[1]) == 5_000


@pytest.mark.parametrize("delimiter", [";", "\t", "|", "^", "-"])
def test_delimiters(spark, delimiter):
    assert raw(spark, f'a{delimiter}"x{delimiter}y"\n', delimiter=delimiter) == [["a", f"x{delimiter}y"]]


@pytest.mark.parametrize("bad", ["", ",,", '"', "\n", "é"])
def test_bad_delimiters(bad):
    with pytest.raises(ValueError):
        DecodeOptions(delimiter=bad)


field = st.text(alphabet='a,"\r\n é;', max_size=6)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(field, field), min_size=1, max_size=20))
def test_round_trip_and_csv_module(spark, rows):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i long, a string, b string").coalesce(1)
    text = Encoder().to_string(df.orderBy("i"))
    assert [tuple(r) for r in csv.reader(io.StringIO(text, newline=""))][1:] == [(str(i), a, b) for i, (a, b) in enumerate(rows)]
    back = Decoder(DecodeOptions(trim_whitespace=False)).parse_text(spark, text, "i long not null, a string not null, b string not null")
    assert [tuple(r) for r in back.orderBy("i").collect()] == [(i, a, b) for i, (a, b) in enumerate(rows)]


@pytest.mark.parametrize(("data", "encoding"), [
    ("n,v\nJosé,1".encode("latin-1"), "ISO-8859-1"), ("n,v\n100€,1".encode("cp1252"), "windows-1252"), ("n,v\nJosé,1".encode("utf-16"), "UTF-16"),
    (b"\xfe\xff" + "n,v\nJosé,1".encode("utf-16-be"), "UTF-8"), ("n,v\nJosé,1".encode("utf-16-le"), "UTF-16LE"), (b"\xef\xbb\xbf" + "n,v\nJosé,1".encode(), "UTF-8"), ("n,v\nJosé,1".encode("utf-32"), "UTF-32"),
])
def test_charsets(spark, data, encoding):
    row = Decoder(DecodeOptions(encoding=encoding)).parse_bytes(spark, data, "n string not null, v long").first()
    assert row.n in ("José", "100€") and row.v == 1


def test_unterminated(spark):
    with pytest.raises(Exception, match="Unterminated quoted field"):
        Decoder().parse_text(spark, 'a,b\n1,"x\n', AB).collect()
    rows = Decoder(DecodeOptions(on_error="permissive")).parse_text(spark, 'a,b\n1,2\n3,"x\n', AB, True).collect()
    assert [len(r._errors) for r in rows] == [0, 1] and rows[1]._errors[0].row == 3
    assert "unmatched quotes" in rows[1]._errors[0].suggestion


def test_strict(spark):
    strict = Decoder(DecodeOptions(mode="strict", expected_field_count=2, on_error="permissive"))
    rows = strict.parse_text(spark, 'a,b\n1,2\n1\n1,2,3\nx"y,2\n"a"b,2\n"ok","a ""q"""', AB).collect()
    assert [len(r._errors) > 0 for r in rows] == [False, True, True, True, True, False]
    long = "x" * 200
    assert Decoder(DecodeOptions(mode="strict", on_error="permissive")).parse_text(spark, f'a,b\n{long}"{long},1', AB).first()._errors


def test_lenient_ragged(spark):
    rows = Decoder().parse_text(spark, "a,b\n1\n1,2,3", AB).collect()
    assert [tuple(r) for r in rows] == [("1", None), ("1", "2")]


def test_trim(spark):
    options = dict(keep_row=False)
    assert Decoder().parse_text(spark, ' a ,b\n" x ", y\t', AB, **options).first() == ("x", "y")
    assert Decoder(DecodeOptions(trim_whitespace=False)).parse_text(spark, 'a,b\n" x ", y', AB, **options).first() == (" x ", " y")


def test_tiers_agree(spark, tmp_path):
    df = spark.range(500).selectExpr("id", "concat('n,', id) as name", "id * 0.5 as half").repartition(3)
    Encoder().write(df, str(tmp_path / "t"))
    schema = "id long not null, name string not null, half double not null"
    expected = sorted(map(tuple, df.selectExpr("id", "name", "cast(half as double)").collect()))
    for tier in ("exact", "lines", "native"):
        assert sorted(map(tuple, Decoder().read(spark, str(tmp_path / "t"), schema, tier).collect())) == expected, tier


def test_approximate_rows(spark):
    docs = scan.texts(spark.createDataFrame([("a\nb\n",), ("c",), ("",)], "t string"), "t")
    assert scan.approximate_rows(docs).first().lines == 2


def test_single_empty_column(spark):
    df = spark.createDataFrame([("",), ("x",), (None,)], "a string").coalesce(1)
    text = Encoder().to_string(df)
    assert text == 'a\n""\nx\n""'
    assert len(Decoder().parse_text(spark, text, "a string").collect()) == 3


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "x\ny"), (2, None)], "id long, s string").coalesce(1)
    assert Encoder(EncodeOptions(includes_trailing_newline=True)).to_string(df) == 'id,s\n1,"x\ny"\n2,\n'
    assert Encoder(EncodeOptions(has_headers=False, line_ending="\r\n")).to_bytes(df) == b'1,"x\ny"\r\n2,'
    assert Encoder().to_string(df.filter("id > 5")) == ""
    assert list(Encoder().pull(df)) == ["id,s\n", '1,"x\ny"\n', "2,\n"]
    Encoder(EncodeOptions(line_ending="\r\n")).write(df, str(tmp_path / "crlf"), single=True, order=["id"])
    found = spark.read.format("binaryFile").load(str(tmp_path / "crlf")).filter(F.length("content") > 0).first().content
    assert bytes(found) == b'id,s\r\n1,"x\ny"\r\n2,\r\n'
    Encoder().write_native(df, str(tmp_path / "native"))
    assert [tuple(r) for r in Decoder().read(spark, str(tmp_path / "native"), "id long not null, s string").orderBy("id").collect()] == [(1, "x\ny"), (2, None)]
    with pytest.raises(ValueError):
        Encoder(EncodeOptions(line_ending="\r\n")).write_native(df, str(tmp_path / "no"))


def test_each_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n4,3\n")
    rows = Decoder().read(spark, str(tmp_path / "*.csv"), "x long, y long").collect()
    assert sorted((r.x, r.y) for r in rows) == [(1, 2), (3, 4)]


def test_lines_keep_records_like_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,v\nname,v\nb,c\n")
    for tier in ("exact", "lines"):
        rows = Decoder().read(spark, str(tmp_path / "a.csv"), "name string, v string", tier).collect()
        assert sorted((r.name, r.v) for r in rows) == [("b", "c"), ("name", "v")]


def test_instants_are_written_in_utc(spark):
    from sheaf.functions.format import date_text
    from sheaf.options import Dates

    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.sql("SELECT timestamp_micros(1710082800000000) AS t UNION ALL SELECT timestamp_micros(-1500000)")
        assert sorted(r.s for r in df.select(date_text(df.t, Dates.iso8601()).alias("s")).collect()) == ["1969-12-31T23:59:58Z", "2024-03-10T15:00:00Z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
