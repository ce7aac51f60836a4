"""One query for each operator: columns of the tables are encoded as delimited text and decoded again."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf import schema as S
from sheaf.functions import format as W
from sheaf.functions import text as X
from sheaf.functions import values as V
from sheaf.operators.decode import Decoder, batches
from sheaf.operators.encode import Encoder
from sheaf.options import Bools, Dates, DecodeOptions, EncodeOptions, Keys, Nested, Nils, Numbers
from sheaf.sources import scan
from sheaf.storage import fresh_path
from sheaf.streaming import stream

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels", "conversations")


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def required(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, False, f.metadata) for f in schema.fields])


def through_files(df: DataFrame, encode: EncodeOptions | None = None, decode: DecodeOptions | None = None, schema: T.StructType | None = None, tier: str = "exact", keep_row: bool = False) -> DataFrame:
    """Written as files of records and read back."""
    path = fresh_path(df.sparkSession, "text")
    Encoder(encode or EncodeOptions(dates=Dates.formatted(MICROS))).write(df, path)
    return Decoder(decode or DecodeOptions(dates=Dates.formatted(MICROS))).read(df.sparkSession, path, schema or required(df.schema), tier, keep_row=keep_row)


def one_field(df: DataFrame, id_col: str, text: Column, kind: str, options: DecodeOptions, nullable: bool = True, metadata: dict | None = None) -> DataFrame:
    """Decode one text a row as field ``v`` of a named row, beside an id."""
    cells = df.select(F.create_map(F.lit("id"), F.col(id_col).cast("string"), F.lit("v"), text).alias("m"))
    schema = T.StructType([T.StructField(id_col, T.LongType(), False, {S.NAME: "id"}), T.StructField("v", T.StructType.fromDDL(f"v {kind}")["v"].dataType, nullable, metadata or {})])
    return Decoder(options).rows(cells, "m", schema)


def document(df: DataFrame, by: Column, encode: EncodeOptions, order: list[str]) -> DataFrame:
    """(src, content): a document for each value of ``by``."""
    out = Encoder(encode).documents(df.withColumn("__by", by), ["__by"], order, "content")
    return out.select(F.col("__by").cast("string").alias("src"), "content")


# -- whole tables ------------------------------------------------------------------------------------------------------


@query
def flagship_filter_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decode orders, keep the open ones, sum their prices by priority."""
    orders = through_files(table(spark, sf_dir, "orders"))
    return orders.filter("o_orderstatus = 'O'").groupBy("o_orderpriority").agg(F.count("*").alias("n_orders"), F.round(F.sum(F.col("o_totalprice").cast("decimal(20,4)")), 2).cast("double").alias("revenue"))


def _roundtrip(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return through_files(table(spark, sf_dir, name))


for _name in TABLES:
    REGISTRY[f"roundtrip_{_name}"] = partial(_roundtrip, _name)


@query
def roundtrip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The splittable reader, for records without line ends inside."""
    return through_files(table(spark, sf_dir, "lineitem"), tier="lines")


@query
def roundtrip_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark's reader."""
    return through_files(table(spark, sf_dir, "lineitem"), tier="native")


@query
def roundtrip_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes, delimiters and all kinds of line ends."""
    text = F.concat(F.lit('"'), F.replace(F.replace("text", F.lit(" the "), F.lit(' "the", ')), F.lit("\n"), F.lit("\r\n")), F.lit("\r"))
    return through_files(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), decode=DecodeOptions(trim_whitespace=False))


@query
def wide_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five of fifty columns."""
    cols = [F.concat(F.lit(f"value{i}_"), F.col("c_custkey")).alias(f"col{i}") for i in range(50)]
    schema = T.StructType([T.StructField(f"col{i}", T.StringType(), False) for i in (0, 7, 21, 34, 49)])
    return through_files(table(spark, sf_dir, "customer").select(*cols), schema=schema)


@query
def mixed_map_reencode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decode, change every column, encode."""
    rows = through_files(table(spark, sf_dir, "customer").select("c_name", "c_custkey", "c_nationkey"))
    changed = rows.select(F.upper("c_name").alias("name"), (F.col("c_custkey") + 1).alias("id"), (F.col("c_nationkey") * 0.5).cast("double").alias("half"))
    return Encoder().rows(changed)


# -- records and fields ------------------------------------------------------------------------------------------------


@query
def escape_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace("text", F.lit(" the "), F.lit(' "the", '))
    return table(spark, sf_dir, "documents").select("doc_id", X.needs_quoting(text).alias("quoted"), X.escaped(text).alias("field"))


@query
def unescape_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace("text", F.lit(" the "), F.lit(' "the", '))
    return table(spark, sf_dir, "documents").select("doc_id", X.unescaped(X.escaped(text)).alias("field"))


def _encode_row(options: EncodeOptions, spark: SparkSession, sf_dir: str) -> DataFrame:
    return Encoder(options).rows(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"))


REGISTRY["encode_row"] = partial(_encode_row, EncodeOptions())
REGISTRY["encode_semicolon"] = partial(_encode_row, EncodeOptions(delimiter=";"))


@query
def encode_lines_crlf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Encoder(EncodeOptions(line_ending="\r\n")).lines(table(spark, sf_dir, "nation"))


@query
def encode_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Encoder().dictionaries(table(spark, sf_dir, "nation"))
    return rows.select(F.explode("row").alias("key", "value"))


@query
def encode_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = Encoder(EncodeOptions(keys=Keys.screaming())).headers("customerId long, accountBalance double, marketSegment string")
    return table(spark, sf_dir, "region").select("r_regionkey", F.lit(",".join(names)).alias("header"))


@query
def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record numbers and fields without types."""
    docs = document(table(spark, sf_dir, "nation"), F.col("n_regionkey"), EncodeOptions(has_headers=False), ["n_nationkey"])
    raw = Decoder().raw(docs)
    return raw.select(F.col("src").alias("region"), "row", F.size("fields").cast("long").alias("width"), F.get("fields", F.lit(1)).alias("name"), F.get("fields", F.lit(9)).isNull().alias("beyond"))


@query
def record_split_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they are, read as records of one field that may break at quotes and commas."""
    docs = scan.texts(table(spark, sf_dir, "documents"), "text", F.col("doc_id").cast("string"))
    counts = Decoder().raw(docs).groupBy("src").agg(F.count("*").alias("n_records"))
    return counts.select(F.col("src").cast("long").alias("doc_id"), "n_records")


@query
def field_count_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan.texts(table(spark, sf_dir, "documents"), "text", F.col("doc_id").cast("string"))
    return Decoder().raw(docs).groupBy(F.size("fields").cast("long").alias("width")).agg(F.count("*").alias("n_records"))


@query
def approximate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.approximate_rows(scan.texts(table(spark, sf_dir, "documents"), "text"))


@query
def trim_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit("  \t"), F.col("n_name"), F.lit("  "))
    return one_field(table(spark, sf_dir, "nation"), "n_nationkey", padded, "string", DecodeOptions())


@query
def charset_utf16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes with a byte order mark, decoded and split. No text has a line feed, so a lone one stands for null."""
    schema = T.StructType.fromDDL("text string not null")
    line = Encoder(EncodeOptions(delimiter="\x1f", nils=Nils.custom("\n"))).row(schema)
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("src"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    data = texts.select("src", F.encode(F.concat(F.lit("text\n"), line), "UTF-16").alias("data"))
    # A row each, so that a text is decoded once and not at each mention by the split.
    docs = data.select("src", F.explode(F.array(scan.decoded(F.col("data")))).alias("content"))
    rows = Decoder(DecodeOptions(delimiter="\x1f", trim_whitespace=False)).documents(docs, schema, names=["text"])
    return rows.select(F.when(F.col("text") != "\n", F.regexp_replace("text", r"\A\p{Zs}+|\p{Zs}+\z", "")).alias("text"))


@query
def charset_latin1(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("n_name"), F.lit("é"))
    return table(spark, sf_dir, "nation").select("n_nationkey", scan.decoded(F.encode(name, "ISO-8859-1"), "ISO-8859-1").alias("name"))


# -- values ------------------------------------------------------------------------------------------------------------


def _token(key: str, *tokens: str) -> Column:
    return F.element_at(F.array(*map(F.lit, tokens)), (F.col(key) % len(tokens) + 1).cast("int"))


def _bools(tokens: tuple[str, ...], how: Bools, spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_field(table(spark, sf_dir, "customer"), "c_custkey", _token("c_custkey", *tokens), "boolean", DecodeOptions(bools=how))


STANDARD_TOKENS = ("true", "No", "1", "off", "Y", "f", "ON", "0")
FLEXIBLE_TOKENS = ("Oui", "nein", "да", "нет", "7", "0", "voll", "假")
CUSTOM_TOKENS = ("Active", "inactive", "ACTIVE", "Inactive")
REGISTRY["bool_standard"] = partial(_bools, STANDARD_TOKENS, Bools.standard())
REGISTRY["bool_flexible"] = partial(_bools, FLEXIBLE_TOKENS, Bools.flexible())
REGISTRY["bool_custom"] = partial(_bools, CUSTOM_TOKENS, Bools.custom(("active",), ("inactive",)))


def _bool_text(how: Bools, spark: SparkSession, sf_dir: str) -> DataFrame:
    field = T.StructField("b", T.BooleanType())
    return table(spark, sf_dir, "customer").select("c_custkey", W.text(F.col("c_acctbal") > 0, field, EncodeOptions(bools=how)).alias("v"))


REGISTRY["bool_encode_numeric"] = partial(_bool_text, Bools.numeric())
REGISTRY["bool_encode_true_false"] = partial(_bool_text, Bools.true_false())
REGISTRY["bool_encode_yes_no"] = partial(_bool_text, Bools.yes_no())


@query
def int_range_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys as 8-bit integers; what does not fit is an error."""
    rows = one_field(table(spark, sf_dir, "customer"), "c_custkey", F.col("c_custkey").cast("string"), "tinyint", DecodeOptions(on_error="permissive"))
    return rows.select("c_custkey", F.col("v").cast("long").alias("v"), (F.size("_errors") > 0).alias("bad"))


@query
def int_refuses_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.col("c_custkey").cast("string"), F.lit(".0"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("+"), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit("1,"), F.col("c_custkey").cast("string")))
    rows = one_field(table(spark, sf_dir, "customer"), "c_custkey", text, "long", DecodeOptions(numbers=Numbers.flexible(), on_error="permissive"))
    return rows.select("c_custkey", "v", F.get("_errors", F.lit(0))["suggestion"].alias("suggestion"))


@query
def unsigned_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = S.UNSIGNED["uint8"]
    rows = one_field(table(spark, sf_dir, "customer"), "c_custkey", (F.col("c_custkey") - 100).cast("string"), kind[1].simpleString(), DecodeOptions(on_error="permissive"), metadata=S.kind("uint8"))
    return rows.select("c_custkey", F.col("v").cast("long").alias("v"))


def _us(x: Column) -> Column:
    return F.format_number(x, 2)


def _eu(x: Column) -> Column:
    return F.translate(_us(x), ",.", ".,")


def _number(text: Callable[[Column], Column], how: Numbers, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = one_field(table(spark, sf_dir, "orders"), "o_orderkey", text(F.col("o_totalprice")), "double", DecodeOptions(numbers=how))
    return rows.select("o_orderkey", F.round("v", 2).alias("v"))


REGISTRY["number_standard"] = partial(_number, lambda x: W.plain_real(F.round(x, 2), T.DoubleType()), Numbers.standard())
REGISTRY["number_flexible_us"] = partial(_number, _us, Numbers.flexible())
REGISTRY["number_flexible_eu"] = partial(_number, _eu, Numbers.flexible())
REGISTRY["number_currency"] = partial(_number, lambda x: F.concat(F.lit("R$ "), _eu(x)), Numbers.currency("BRL", "de_DE"))
REGISTRY["number_currency_after"] = partial(_number, lambda x: F.concat(_us(x), F.lit(" USD")), Numbers.flexible())
REGISTRY["number_units"] = partial(_number, lambda x: F.concat(_us(x), F.lit(" liters")), Numbers.flexible())
REGISTRY["number_locale_de"] = partial(_number, _eu, Numbers.localised("de_DE"))
REGISTRY["number_locale_fr"] = partial(_number, lambda x: F.translate(_us(x), ",.", " ,"), Numbers.localised("fr_FR"))
REGISTRY["number_parsed_us"] = partial(_number, lambda x: F.concat(F.lit("$"), _us(x)), Numbers.parsed("en_US"))


@query
def decimal_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("$"), _us(F.col("o_totalprice")))
    rows = one_field(table(spark, sf_dir, "orders"), "o_orderkey", text, "decimal(18,2)", DecodeOptions(numbers=Numbers.flexible()))
    return rows.select("o_orderkey", (F.col("v") * 100).cast("long").alias("cents"))


@query
def number_encode_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = T.StructField("x", T.DoubleType())
    price = F.round(F.col("p_retailprice") * 1000, 0)
    return table(spark, sf_dir, "part").select("p_partkey", W.text(price, field, EncodeOptions(numbers=Numbers.localised("de_DE"))).alias("v"))


@query
def number_encode_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large numbers, which Spark's cast would write with an exponent."""
    field = T.StructField("x", T.DoubleType())
    return table(spark, sf_dir, "part").select("p_partkey", W.text((F.col("p_partkey") * 12_345_678).cast("double"), field, EncodeOptions()).alias("v"))


def _date(text: Callable[[Column], Column], how: Dates, spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_field(table(spark, sf_dir, "orders"), "o_orderkey", text(F.date_trunc("day", "o_orderdate")), "timestamp", DecodeOptions(dates=how))


def _form(pattern: str) -> Callable[[Column], Column]:
    return lambda x: F.date_format(x, pattern)


def _mixed(x: Column) -> Column:
    forms = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss'Z'", "dd.MM.yyyy", "MMMM d, yyyy", "d MMM yyyy", "yyyyMMdd")
    out = None
    for i, form in enumerate(forms):
        arm = F.date_format(x, form)
        out = F.when(F.col("o_orderkey") % len(forms) == i, arm) if out is None else out.when(F.col("o_orderkey") % len(forms) == i, arm)
    return out


REGISTRY["date_iso"] = partial(_date, _form("yyyy-MM-dd'T'HH:mm:ss'Z'"), Dates.iso8601())
REGISTRY["date_epoch_s"] = partial(_date, lambda x: F.unix_timestamp(x).cast("string"), Dates.seconds())
REGISTRY["date_epoch_ms"] = partial(_date, lambda x: (F.unix_timestamp(x) * 1000).cast("string"), Dates.milliseconds())
REGISTRY["date_formatted"] = partial(_date, _form("yyyy/dd/MM"), Dates.formatted("yyyy/dd/MM"))
REGISTRY["date_flexible"] = partial(_date, _mixed, Dates.flexible())
REGISTRY["date_hint"] = partial(_date, _form("MM/dd/yyyy"), Dates.flexible("MM/dd/yyyy"))
REGISTRY["date_locale_us"] = partial(_date, _form("M/d/yyyy"), Dates.locale_aware("en_US"))
REGISTRY["date_locale_gb"] = partial(_date, _form("dd/MM/yyyy"), Dates.locale_aware("en_GB"))
REGISTRY["date_locale_de_long"] = partial(_date, _form("d.M.yyyy"), Dates.locale_aware("de_DE"))
REGISTRY["date_custom"] = partial(_date, _form("yyyyMMdd"), Dates.custom(lambda x: F.try_to_timestamp(x, F.lit("yyyyMMdd"))))


@query
def date_day_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ambiguous date is day-first."""
    return one_field(table(spark, sf_dir, "nation"), "n_nationkey", F.concat(F.lpad((F.col("n_nationkey") % 12 + 1).cast("string"), 2, "0"), F.lit("/02/2024")), "timestamp", DecodeOptions(dates=Dates.flexible()))


def _date_text(how: Dates, spark: SparkSession, sf_dir: str) -> DataFrame:
    field = T.StructField("x", T.TimestampType())
    return table(spark, sf_dir, "orders").select("o_orderkey", W.text(F.date_trunc("day", "o_orderdate"), field, EncodeOptions(dates=how)).alias("v"))


REGISTRY["date_encode_iso"] = partial(_date_text, Dates.iso8601())
REGISTRY["date_encode_seconds"] = partial(_date_text, Dates.seconds())
REGISTRY["date_encode_millis"] = partial(_date_text, Dates.milliseconds())
REGISTRY["date_encode_formatted"] = partial(_date_text, Dates.formatted("dd.MM.yyyy"))


def _nil(tokens: tuple[str, ...], how: Nils, spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_field(table(spark, sf_dir, "customer"), "c_custkey", _token("c_custkey", *tokens), "string", DecodeOptions(nils=how))


NIL_TOKENS = ("", "null", "NULL", "N/A", "-", "value")
REGISTRY["nil_empty"] = partial(_nil, NIL_TOKENS, Nils.empty())
REGISTRY["nil_literal"] = partial(_nil, NIL_TOKENS, Nils.null_literal())
REGISTRY["nil_custom"] = partial(_nil, NIL_TOKENS, Nils.custom("N/A", "-"))


def _nil_text(how: Nils, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name"))
    return Encoder(EncodeOptions(nils=how)).rows(rows)


REGISTRY["nil_encode_empty"] = partial(_nil_text, Nils.empty())
REGISTRY["nil_encode_literal"] = partial(_nil_text, Nils.null_literal())
REGISTRY["nil_encode_custom"] = partial(_nil_text, Nils.custom("N/A"))


@query
def uuid_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.md5(F.col("c_custkey").cast("string"))
    text = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return one_field(table(spark, sf_dir, "customer"), "c_custkey", text, "string", DecodeOptions(), metadata=S.kind("uuid"))


@query
def url_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").filter("url is not null")
    return one_field(pages, "page_id", F.col("url"), "string", DecodeOptions(), metadata=S.kind("url"))


# -- names and nesting -------------------------------------------------------------------------------------------------

_CAMEL = T.StructType([T.StructField("custKey", T.LongType(), False), T.StructField("fullName", T.StringType(), False), T.StructField("accountBalance", T.DoubleType(), False)])


def _keys(header: tuple[str, str, str], options: DecodeOptions, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(header[0]), F.col("c_name").alias(header[1]), F.col("c_acctbal").alias(header[2]))
    return through_files(rows, decode=options, schema=_CAMEL)


REGISTRY["keys_default"] = partial(_keys, ("custKey", "fullName", "accountBalance"), DecodeOptions())
REGISTRY["keys_snake"] = partial(_keys, ("cust_key", "full_name", "account_balance"), DecodeOptions(keys=Keys.snake()))
REGISTRY["keys_kebab"] = partial(_keys, ("cust-key", "full-name", "account-balance"), DecodeOptions(keys=Keys.kebab()))
REGISTRY["keys_screaming"] = partial(_keys, ("CUST_KEY", "FULL_NAME", "ACCOUNT_BALANCE"), DecodeOptions(keys=Keys.screaming()))
REGISTRY["keys_pascal"] = partial(_keys, ("CustKey", "FullName", "AccountBalance"), DecodeOptions(keys=Keys.pascal()))
REGISTRY["keys_custom"] = partial(_keys, ("x:custKey", "x:fullName", "x:accountBalance"), DecodeOptions(keys=Keys.custom(lambda n: n.removeprefix("x:"))))
REGISTRY["column_mapping"] = partial(_keys, ("Customer No.", "full_name", "account_balance"), DecodeOptions(keys=Keys.snake(), column_mapping={"Customer No.": "custKey"}))
REGISTRY["index_mapping"] = partial(_keys, ("a", "b", "c"), DecodeOptions(index_mapping={0: "custKey", 1: "fullName", 2: "accountBalance"}))


@query
def indexed_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No header: the schema's order is the column order."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return through_files(rows, EncodeOptions(has_headers=False), DecodeOptions(has_headers=False), _CAMEL)


def _keys_text(keys: Keys, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nationKey"), F.col("n_name").alias("fullName"))
    return Encoder(EncodeOptions(keys=keys)).dictionaries(rows).select(F.explode("row").alias("key", "value"))


REGISTRY["keys_encode_snake"] = partial(_keys_text, Keys.snake())
REGISTRY["keys_encode_kebab"] = partial(_keys_text, Keys.kebab())
REGISTRY["keys_encode_screaming"] = partial(_keys_text, Keys.screaming())


def _with_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("nation"))
    return table(spark, sf_dir, "customer").join(nation, "c_nationkey").select("c_custkey", "nation")


@query
def nested_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_nation(spark, sf_dir)
    back = through_files(rows, EncodeOptions(nested=Nested.flatten()), DecodeOptions(nested=Nested.flatten()))
    return back.select("c_custkey", F.col("nation.name").alias("nation_name"), F.col("nation.region").alias("region"))


@query
def nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_nation(spark, sf_dir)
    back = through_files(rows, EncodeOptions(nested=Nested.json()), DecodeOptions(nested=Nested.json()))
    return back.select("c_custkey", F.col("nation.name").alias("nation_name"), F.col("nation.region").alias("region"))


@query
def nested_json_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON in a field, keys sorted."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.struct(F.col("n_regionkey").alias("region"), F.col("n_name").alias("name")).alias("n"))
    return Encoder(EncodeOptions(nested=Nested.json())).rows(rows)


@query
def nested_array_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays live in JSON fields only."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    back = through_files(rows, EncodeOptions(nested=Nested.json()), DecodeOptions(nested=Nested.json()))
    return back.select("vec_id", F.size("embedding").cast("long").alias("width"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


# -- errors ------------------------------------------------------------------------------------------------------------


def _bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in documents by nation; every seventh balance is not a number."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 7 == 0, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string")).alias("balance"))
    docs = document(rows.select("c_custkey", "balance", "c_nationkey"), F.col("c_nationkey"), EncodeOptions(), ["c_custkey"])
    schema = T.StructType.fromDDL("c_custkey long not null, balance double not null")
    return Decoder(DecodeOptions(on_error="permissive")).documents(docs, schema, True, ["c_custkey", "balance"])


@query
def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bad_rows(spark, sf_dir).select("c_custkey", (F.size("_errors") > 0).alias("bad"), F.round("balance", 2).alias("balance"))


@query
def error_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bad_rows(spark, sf_dir).select("c_custkey", F.explode("_errors").alias("e"))
    return rows.select("c_custkey", "e.kind", "e.row", "e.column", "e.expected", "e.actual", "e.message")


@query
def suggest_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header with a typing error, as data."""
    docs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("src"), F.concat(F.lit("naame,age\n"), F.col("n_name"), F.lit(",1")).alias("content"))
    rows = Decoder(DecodeOptions(on_error="permissive")).documents(docs, T.StructType.fromDDL("name string not null, age long not null"), True, ["naame", "age"])
    return rows.select(F.col("_row").alias("row"), F.get("_errors", F.lit(0))["message"].alias("message"))


@query
def key_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance that suggestions go by, as a column."""
    return table(spark, sf_dir, "nation").select("n_nationkey", F.levenshtein(F.lower("n_name"), F.lit("germany")).cast("long").alias("distance"))


@query
def strict_field_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("a,b\n"), F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 3 == 0, F.lit("")).otherwise(F.lit(",x")))
    docs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("src"), text.alias("content"))
    options = DecodeOptions(mode="strict", expected_field_count=2, on_error="permissive")
    rows = Decoder(options).documents(docs, T.StructType.fromDDL("a long, b string"), True, ["a", "b"])
    return rows.select(F.col("a"), F.get("_errors", F.lit(0))["message"].alias("message"))


@query
def strict_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('say "'), F.col("n_name"), F.lit('"'))).otherwise(F.concat(F.lit('"'), F.col("n_name"), F.lit('"')))
    docs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("src"), F.concat(F.lit("a\n"), body).alias("content"))
    rows = Decoder(DecodeOptions(mode="strict", on_error="permissive")).documents(docs, T.StructType.fromDDL("a string not null"), True, ["a"])
    return rows.select("a", (F.size("_errors") > 0).alias("bad"))


@query
def unterminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.when(F.col("n_nationkey") % 5 == 0, F.lit('"')).otherwise(F.lit("")), F.col("n_name"))
    docs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("src"), F.concat(F.lit("a\n"), body).alias("content"))
    rows = Decoder(DecodeOptions(on_error="permissive")).documents(docs, T.StructType.fromDDL("a string"), True, ["a"])
    return rows.groupBy((F.size("_errors") > 0).alias("bad")).agg(F.count("*").alias("n"))


# -- batches and streams -----------------------------------------------------------------------------------------------


@query
def decode_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = document(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), F.col("c_nationkey"), EncodeOptions(has_headers=False), ["c_custkey"])
    rows = Decoder(DecodeOptions(has_headers=False)).documents(docs, T.StructType.fromDDL("c_custkey long not null, c_name string not null"), True)
    return batches(rows, 25).groupBy("_batch").agg(F.count("*").alias("n"))


@query
def encode_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Encoder().batches(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), 100, ["c_custkey"])
    return found.select(F.col("_batch").alias("batch"), F.size("rows").cast("long").alias("n"), F.get("rows", F.lit(0)).alias("first"))


@query
def stream_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of records through a stream into a table."""
    nation = table(spark, sf_dir, "nation")
    path = fresh_path(spark, "incoming")
    Encoder().write(nation, path)
    out = fresh_path(spark, "streamed")
    rows = stream.read_stream(spark, f"{path}/*.txt", required(nation.schema), max_files=1)
    running = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark, "progress")).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(nation.schema).parquet(out)


@query
def stream_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of rows written as records, read back in batch."""
    orders = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    source, out = fresh_path(spark, "rows"), fresh_path(spark, "records")
    orders.write.parquet(source)
    running = stream.write_stream(spark.readStream.schema(orders.schema).parquet(source), out, fresh_path(spark, "progress"))
    running.awaitTermination()
    return Decoder().read(spark, f"{out}/*", required(orders.schema))


@query
def progress_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and bytes of the records, as progress reports them."""
    encoder = Encoder()
    nation = table(spark, sf_dir, "nation")
    return encoder.lines(nation).agg(F.count("*").alias("rows"), F.sum(F.octet_length("line")).cast("long").alias("bytes"))


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
