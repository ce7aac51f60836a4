"""Texts to values and back."""

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf import schema as S
from sheaf.errors import UnsupportedType
from sheaf.functions import format as W
from sheaf.functions import values as V
from sheaf.operators.decode import Decoder
from sheaf.operators.encode import Encoder
from sheaf.options import Bools, Dates, DecodeOptions, EncodeOptions, Nils, Numbers


def apply(spark, texts, f):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string").select("i", f(F.col("v")).alias("v")).orderBy("i").collect()
    return [r.v for r in rows]


def test_strip(spark):
    pairs = {"$100": "100", "€50": "50", "£75": "75", "¥1000": "1000", "100 USD": "100", "EUR 200": "200", "CHF 150": "150", "R$ 500": "500", "100 km": "100", "50 mi": "50", "45.5 L": "45.5", "10 gal": "10", "75 liters": "75", "100": "100", "1234.56": "1234.56", "-50": "-50", "0.99": "0.99", "12kg": "12", "5 m": "5", "usd 7": "7"}
    assert apply(spark, pairs, V.stripped) == list(pairs.values())


def test_flexible_numbers(spark):
    pairs = {"1,234.56": 1234.56, "1.234,56": 1234.56, "$1,234.56": 1234.56, "€1.234,56": 1234.56, "45,50": 45.5, "1,234": 1234.0, "1,234,567": 1234567.0, "-$50.00": -50.0, "1.234,56 €": 1234.56, "1.234.567": None, "": None, "abc": None, "12.5": 12.5}
    assert apply(spark, pairs, lambda x: V.real(x, Numbers.flexible(), T.DoubleType())) == list(pairs.values())


def test_standard_reals(spark):
    pairs = {"1.5": 1.5, "1.5d": None, " 1.5": None, "1e3": 1000.0, "+2": 2.0, ".5": 0.5, "inf": float("inf"), "0x1p3": 8.0, "1,5": None, "": None}
    assert apply(spark, pairs, lambda x: V.real(x, Numbers.standard(), T.DoubleType())) == list(pairs.values())


@pytest.mark.parametrize(("locale", "text", "value"), [("de_DE", "1.234,56", 1234.56), ("en_US", "1,234.56", 1234.56), ("fr_FR", "1 234,5", 1234.5), ("fr_FR", "1 234,5", 1234.5), ("en_US", "1.234,56", None), ("de_DE", "12,5", 12.5), ("de_DE", "1.23", None)])
def test_locale_numbers(spark, locale, text, value):
    assert apply(spark, [text], lambda x: V.real(x, Numbers.localised(locale), T.DoubleType())) == [value]


def test_parsed_numbers_fall_back(spark):
    assert apply(spark, ["$1.234,56", "EUR 12,5"], lambda x: V.real(x, Numbers.parsed("en_US"), T.DoubleType())) == [1234.56, 12.5]
    with pytest.raises(ValueError, match="unknown locale"):
        Numbers.localised("xx_XX") and V.localised(F.lit("1"), "xx_XX")


def test_decimals_are_exact(spark):
    got = apply(spark, ["$1,234.10", "0.1"], lambda x: V.decimal(x, Numbers.flexible(), T.DecimalType(20, 4)))
    assert got == [decimal.Decimal("1234.1000"), decimal.Decimal("0.1000")]


@pytest.mark.parametrize(("kind", "texts", "expected"), [
    (T.ByteType(), ["127", "128", "-128", "+5", " 5", "5.0", "1,2"], [127, None, -128, 5, None, None, None]),
    (T.LongType(), ["9223372036854775807", "9223372036854775808"], [9223372036854775807, None]),
])
def test_integers(spark, kind, texts, expected):
    assert apply(spark, texts, lambda x: V.integer(x, kind)) == expected


def test_unsigned(spark):
    assert apply(spark, ["255", "256", "-1"], lambda x: V.integer(x, T.ShortType(), "uint8")) == [255, None, None]
    assert apply(spark, ["18446744073709551615", "18446744073709551616"], lambda x: V.integer(x, T.DecimalType(20, 0), "uint64")) == [decimal.Decimal(18446744073709551615), None]


def test_bools(spark):
    standard = {"TRUE": True, "yes": True, "1": True, "y": True, "t": True, "on": True, "false": False, "no": False, "0": False, "n": False, "f": False, "Off": False, "oui": None, "2": None}
    assert apply(spark, standard, lambda x: V.boolean(x, Bools.standard())) == list(standard.values())
    flexible = {"Oui": True, "sí": True, "ДА": True, "是": True, "fulltank": True, "non": False, "нет": False, "部分": False, "7": True, "0": False, "x": None}
    assert apply(spark, flexible, lambda x: V.boolean(x, Bools.flexible())) == list(flexible.values())
    custom = {"Active": True, "INACTIVE": False, "both": True, "x": None}
    assert apply(spark, custom, lambda x: V.boolean(x, Bools.custom(("active", "both"), ("inactive", "both")))) == list(custom.values())


D = dt.datetime(2024, 1, 15)


def test_dates(spark):
    flexible = {"2024-01-15": D, "15/01/2024": D, "2024-01-15T10:30:00Z": D.replace(hour=10, minute=30), "2024-01-15T10:30:00+0200": D.replace(hour=8, minute=30), "15.01.2024": D, "01/02/2024": dt.datetime(2024, 2, 1), "01/15/2024": D, "15/01/24": D, "January 15, 2024": D, "15 Jan 2024": D, "20240115": D, "nope": None, "": None, "  2024-01-15 ": D}
    assert apply(spark, flexible, lambda x: V.instant(x, Dates.flexible())) == list(flexible.values())
    assert apply(spark, ["01/02/2024", "2024-01-15"], lambda x: V.instant(x, Dates.flexible("MM/dd/yyyy"))) == [dt.datetime(2024, 1, 2), D]
    assert apply(spark, ["1705276800", "1705276800.5", "x"], lambda x: V.instant(x, Dates.seconds())) == [D, D.replace(microsecond=500_000), None]
    assert apply(spark, ["1705276800000"], lambda x: V.instant(x, Dates.milliseconds())) == [D]
    assert apply(spark, ["2024-01-15T00:00:00Z", "2024-01-15"], lambda x: V.instant(x, Dates.iso8601())) == [D, None]
    assert apply(spark, ["12/25/2024"], lambda x: V.instant(x, Dates.locale_aware("en_US"))) == [dt.datetime(2024, 12, 25)]
    assert apply(spark, ["25/12/2024"], lambda x: V.instant(x, Dates.locale_aware("en_GB"))) == [dt.datetime(2024, 12, 25)]
    today = apply(spark, ["today", "Yesterday"], lambda x: V.instant(x, Dates.flexible()))
    assert today[0] - today[1] == dt.timedelta(days=1)
    with pytest.raises(UnsupportedType):
        V.instant(F.lit("x"), Dates.deferred())


def test_nils(spark):
    schema = "a string, n long"
    for nils, text, expected in ((Nils.empty(), "a,n\n,\nnull,", [(None, None), ("null", None)]), (Nils.null_literal(), "a,n\nNULL,null", [(None, None)]), (Nils.custom("N/A", "-"), "a,n\nN/A,-\nn/a,1", [(None, None), ("n/a", 1)])):
        assert [tuple(r) for r in Decoder(DecodeOptions(nils=nils)).parse_text(spark, text, schema).collect()] == expected
    assert Decoder().parse_text(spark, "a,n\n,", "a string not null, n long").first() == ("", None)
    assert Decoder().parse_text(spark, "a,n\nx,  ", schema).first() == ("x", None)


def test_uuid_and_url(spark):
    schema = T.StructType([T.StructField("u", T.StringType(), False, S.kind("uuid")), T.StructField("l", T.StringType(), True, S.kind("url"))])
    text = "u,l\ne621e1f8-c36c-495a-93fc-0c247a3e6e5f,https://example.com/a?b=1"
    assert Decoder().parse_text(spark, text, schema).first() == ("E621E1F8-C36C-495A-93FC-0C247A3E6E5F", "https://example.com/a?b=1")
    with pytest.raises(Exception, match="expected UUID"):
        Decoder().parse_text(spark, "u,l\nxyz,", schema).collect()


def test_allowed_values(spark):
    schema = T.StructType([T.StructField("s", T.StringType(), False, {S.VALUES: ["new", "old"]})])
    rows = Decoder(DecodeOptions(on_error="permissive")).parse_text(spark, "s\nnew\nother", schema).collect()
    assert [len(r._errors) for r in rows] == [0, 1]


@pytest.mark.parametrize(("value", "text"), [(88.0, "88.0"), (12345678.5, "12345678.5"), (1e-7, "0.0000001"), (-1.5e10, "-15000000000.0"), (0.1, "0.1"), (1e22, "10000000000000000000000.0"), (-0.00012, "-0.00012")])
def test_reals_as_text(spark, value, text):
    assert spark.createDataFrame([(value,)], "v double").select(W.plain_real(F.col("v"), T.DoubleType())).first()[0] == text


def test_refused_reals(spark):
    for bad in (float("nan"), float("inf")):
        with pytest.raises(Exception, match="Invalid value"):
            Encoder().rows(spark.createDataFrame([(bad,)], "v double")).collect()


def test_values_as_text(spark):
    df = spark.createDataFrame([(True, decimal.Decimal("12.3400"), D, None)], "b boolean, d decimal(10,4), t timestamp, s string")
    row = lambda **o: Encoder(EncodeOptions(**o)).rows(df).first()[0]
    assert row() == "1,12.34,2024-01-15T00:00:00Z,"
    assert row(bools=Bools.yes_no(), dates=Dates.seconds(), nils=Nils.custom("N/A")) == "yes,12.34,1705276800.0,N/A"
    assert row(bools=Bools.true_false(), dates=Dates.formatted("dd/MM/yyyy"), nils=Nils.null_literal()) == "true,12.34,15/01/2024,null"
    assert row(bools=Bools.custom("J", "N"), dates=Dates.milliseconds()) == "J,12.34,1705276800000.0,"
    with pytest.raises(UnsupportedType):
        row(dates=Dates.deferred())
    grouped = Encoder(EncodeOptions(numbers=Numbers.localised("de_DE"), delimiter=";")).rows(spark.createDataFrame([(1234567.891,)], "v double")).first()[0]
    assert grouped == "1.234.567,891"


def test_all_types_round_trip(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 1.5, 2.25, decimal.Decimal("1.50"), "x", True)], "a byte, b short, c int, d long, e float, f double, g decimal(10,2), h string, i boolean")
    assert Decoder().parse_text(spark, Encoder().to_string(df), df.schema).collect() == df.collect()
