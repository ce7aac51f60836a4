"""Keys, schemas, nesting, errors, streams, options."""

from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf import errors as E
from sheaf import keys as K
from sheaf import schema as S
from sheaf.errors import Location, UnsupportedType
from sheaf.operators.decode import Decoder, batches, split_errors
from sheaf.operators.encode import Encoder, numbered
from sheaf.options import Dates, DecodeOptions, EncodeOptions, Keys, MemoryOptions, Nested, Numbers, ParallelOptions
from sheaf.streaming import stream

SIMPLE = "name string not null, age long not null, score double not null"


@pytest.mark.parametrize(("keys", "name", "expected"), [
    (Keys.snake(), "first_name", "firstName"), (Keys.snake(), "_first__name_", "firstName"), (Keys.snake(), "user_ID", "userId"), (Keys.kebab(), "first-name", "firstName"),
    (Keys.screaming(), "FIRST_NAME", "firstName"), (Keys.pascal(), "FirstName", "firstName"), (Keys.default(), "x_y", "x_y"), (Keys.custom(str.lower), "ABC", "abc"),
])
def test_decoded_keys(keys, name, expected):
    assert K.decoded_key(name, keys) == expected


@pytest.mark.parametrize(("keys", "name", "expected"), [(Keys.snake(), "firstName", "first_name"), (Keys.snake(), "userID", "user_i_d"), (Keys.kebab(), "firstName", "first-name"), (Keys.screaming(), "firstName", "FIRST_NAME"), (Keys.snake(), "Name", "name"), (Keys.default(), "aB", "aB")])
def test_encoded_keys(keys, name, expected):
    assert K.encoded_key(name, keys) == expected


def test_resolution():
    assert K.resolved(["a", "b"], None, 2, DecodeOptions(index_mapping={0: "x", 2: "z"})) == ["x", "column1", "z"]
    assert K.resolved([" first_name ", "Id"], None, 2, DecodeOptions(keys=Keys.snake(), column_mapping={"Id": "identifier"})) == ["firstName", "identifier"]
    assert K.resolved(None, ["p", "q"], 2, DecodeOptions(has_headers=False)) == ["p", "q"]
    assert K.resolved(None, None, 3, DecodeOptions(has_headers=False)) == ["column0", "column1", "column2"]
    assert K.positions(["a", "b", "a"]) == {"a": 2, "b": 1}
    with pytest.raises(ValueError):
        K.positions(["a", "a"], "error")


def test_mappings(spark):
    one = lambda options, text: tuple(Decoder(options).parse_text(spark, text, SIMPLE).first())
    assert one(DecodeOptions(column_mapping={"Full Name": "name"}), "Full Name,age,score\nA,1,2") == ("A", 1, 2.0)
    assert one(DecodeOptions(has_headers=False, index_mapping={0: "name", 1: "age", 2: "score"}), "A,1,2") == ("A", 1, 2.0)
    assert one(DecodeOptions(index_mapping={2: "name", 0: "age", 1: "score"}), "x,y,z\n1,2,A") == ("A", 1, 2.0)
    assert one(DecodeOptions(has_headers=False), "A,1,2") == ("A", 1, 2.0)
    assert one(DecodeOptions(), "score,extra,name,age\n2,q,A,1") == ("A", 1, 2.0)


@S.csv_indexed
class Indexed:
    third: str
    first: int
    second: float | None
    label: str = S.csv_column("Label Text", default="")

    @property
    def computed(self) -> str:
        return "not stored"


def test_indexed(spark):
    assert Indexed.csv_columns == ["third", "first", "second", "Label Text"]
    assert [f.nullable for f in Indexed.csv_schema.fields] == [False, False, True, False]
    row = Decoder(DecodeOptions(has_headers=False)).parse_text(spark, "a,1,,z", Indexed.csv_schema).first()
    assert tuple(row) == ("a", 1, None, "z")
    assert Decoder().parse_text(spark, "Label Text,first,third\nz,1,a", Indexed.csv_schema).first().label == "z"
    assert Encoder().header_row(Indexed.csv_schema) == "third,first,second,Label Text"
    with pytest.raises(TypeError):
        S.csv_indexed(lambda: None)
    with pytest.raises(TypeError):
        S.schema_of(int)


@dataclass
class Address:
    street: str
    city: str


@dataclass
class Person:
    name: str
    address: Address
    tags: list[str]


def test_nested_flatten(spark):
    schema = T.StructType([f for f in S.schema_of(Person).fields if f.name != "tags"])
    flat = Nested.flatten(".")
    text = "name,address.street,address.city\nA,Main,Rome"
    rows = Decoder(DecodeOptions(nested=flat)).parse_text(spark, text, schema)
    assert rows.first().address.city == "Rome"
    assert Encoder(EncodeOptions(nested=flat)).to_string(rows) == text


def test_nested_json(spark):
    schema = S.schema_of(Person)
    json = Nested.json()
    rows = Decoder(DecodeOptions(nested=json)).parse_text(spark, 'name,address,tags\nA,"{""street"":""Main"",""city"":""Rome""}","[""x"",""y""]"', schema)
    row = rows.first()
    assert (row.address.street, row.tags) == ("Main", ["x", "y"])
    assert Encoder(EncodeOptions(nested=json)).rows(rows).first()[0] == 'A,"{""city"":""Rome"",""street"":""Main""}","[""x"",""y""]"'


def test_nested_error(spark):
    with pytest.raises(UnsupportedType):
        Decoder().parse_text(spark, "name\nA", S.schema_of(Person))
    with pytest.raises(UnsupportedType):
        Encoder().rows(spark.createDataFrame([(([1]),)], "a array<int>"))


def test_locations():
    assert str(Location(5, "name")) == "row 5, column 'name'"
    assert str(Location(10)) == "row 10"
    assert str(Location(column="age")) == "column 'age'"
    assert str(Location()) == "unknown location"
    assert str(Location(2, "a", ("x", "y"))) == "row 2, column 'a', path: x.y"
    assert Location(1, "a", available=("q",)) == Location(1, "a")


def test_suggestions():
    assert E.similar_key("name", ["naame", "age"]) == "Did you mean 'naame'?"
    assert E.similar_key("name", ["NAME"]) == "Did you mean 'NAME'? (case differs)"
    assert E.similar_key("xyz", ["foofoofoo", "barbarbar"]) == "Available columns: 'foofoofoo', 'barbarbar'"
    assert E.similar_key("q" * 20, [f"{i}{'column' * 4}" for i in range(9)]) is None
    assert E.similar_key("name", []) is None
    assert "semicolon" in E.parsing_fix("bad delimiter")
    assert str(E.KeyNotFound("name", Location(2, "name", available=("naame",)))).startswith("Key 'name' not found in CSV row at row 2, column 'name'. Did you mean")


def test_error_rows(spark):
    text = "name,age,score\nA,1,2\nB,x,2\nC,3,\n"
    rows = Decoder(DecodeOptions(on_error="permissive")).parse_text(spark, text, SIMPLE, True)
    good, bad = split_errors(rows)
    assert [r.name for r in good.collect()] == ["A"]
    errors = {r._row: r._errors[0] for r in bad.collect()}
    assert errors[3].message == "Type mismatch: expected Int, found 'x' at row 3, column 'age'" and errors[4].column == "score"
    with pytest.raises(Exception, match="at row 3, column 'age'"):
        Decoder().parse_text(spark, text, SIMPLE).collect()


@pytest.mark.parametrize(("kind", "options", "text", "hint"), [
    ("long", DecodeOptions(), "1.5", "decimal"), ("long", DecodeOptions(), "$5", "currency"), ("double", DecodeOptions(), "1.234,56", "European"), ("boolean", DecodeOptions(), "oui", "boolean-like"),
    ("timestamp", DecodeOptions(dates=Dates.flexible()), "99/99/2024", "appears to be a date"), ("timestamp", DecodeOptions(dates=Dates.iso8601()), "1705276800", "timestamp"),
])
def test_type_suggestions(spark, kind, options, text, hint):
    from dataclasses import replace

    row = Decoder(replace(options, on_error="permissive")).parse_text(spark, f'v\n"{text}"', f"v {kind} not null").first()
    assert hint in row._errors[0].suggestion


def test_named_rows(spark):
    df = spark.createDataFrame([({"name": "A", "age": "1", "score": "2"},)], "m map<string,string>")
    assert tuple(Decoder().rows(df, "m", SIMPLE).first()) == ("A", 1, 2.0)
    with pytest.raises(Exception, match="Key 'score' not found"):
        Decoder().rows(spark.createDataFrame([({"name": "A", "age": "1"},)], "m map<string,string>"), "m", SIMPLE).collect()
    assert Encoder().dictionaries(df.select(F.lit(1).alias("a"), F.lit("x,y").alias("b"))).first()[0] == {"a": "1", "b": "x,y"}


def test_batches(spark):
    text = "n\n" + "\n".join(map(str, range(100)))
    rows = Decoder().parse_text(spark, text, "n long not null", True)
    assert sorted(r["count"] for r in batches(rows, 25).groupBy("_batch").count().collect()) == [1, 24, 25, 25, 25]
    assert [len(b) for b in Decoder().pull(rows, 40)] == [40, 40, 20]
    made = Encoder().batches(spark.range(95).repartition(4), 30, ["id"]).orderBy("_batch").collect()
    assert [len(r.rows) for r in made] == [30, 30, 30, 5] and made[1].rows[0] == "30"
    assert sorted((r.id, r["__n"]) for r in numbered(spark.range(50).repartition(3), ["id"]).collect()) == [(i, i) for i in range(50)]


def test_streams(spark, tmp_path):
    df = spark.range(60).selectExpr("id", "concat('n', id) as name").repartition(3)
    Encoder().write(df, str(tmp_path / "in"))
    rows = stream.read_stream(spark, f"{tmp_path}/in/*.txt", "id long not null, name string not null", max_files=1, keep_row=True)
    seen = []
    query = stream.write_stream(rows.drop("_row"), str(tmp_path / "out"), str(tmp_path / "cp"), on_batch=lambda *x: seen.append(x))
    query.awaitTermination()
    back = Decoder().read(spark, f"{tmp_path}/out/*", "id long not null, name string not null")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert sum(rows for _, rows, _ in seen) == 60 and len(seen) == 3


def test_progress(spark, tmp_path):
    df = spark.range(30)
    done = stream.encode_with_progress(df, str(tmp_path / "x"))
    assert (done.rows, done.fraction) == (30, 1.0)
    told = []
    table, report = stream.decode_with_progress(spark, str(tmp_path / "x"), "id long not null", told.append)
    assert table.count() == 30
    report()
    assert told[0].rows == 30 and told[0].fraction == 1.0 and told[0].estimated_rows >= 30


def test_option_limits():
    assert ParallelOptions(0, 1, 1) == ParallelOptions(1, 64 << 10, 100)
    m = MemoryOptions(memory_budget=1, estimated_row_size=1, batch_size=0, high_watermark=2, low_watermark=0.99)
    assert (m.memory_budget, m.estimated_row_size, m.batch_size, m.high_watermark) == (1 << 20, 64, 1, 1.0) and abs(m.low_watermark - 0.9) < 1e-9
    for bad in (dict(mode="x"), dict(on_error="x"), dict(index_mapping={-1: "a"})):
        with pytest.raises(ValueError):
            DecodeOptions(**bad)
    with pytest.raises(ValueError):
        EncodeOptions(line_ending="\r")


def test_plan_has_no_python_and_no_shuffle(spark, tmp_path):
    Encoder().write(spark.range(10), str(tmp_path / "p"))
    df = Decoder(DecodeOptions(numbers=Numbers.flexible())).read(spark, str(tmp_path / "p"), "id long not null")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
