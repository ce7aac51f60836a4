"""Every registered query of this library against its SQL, over whole tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
from sheaf.plans import queries, sql  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        connection.sql(f"create view {name.split('.')[0]} as select * from '{FOLDER}/{name}'")
    return connection


def test_all_have_sql():
    assert set(queries.queries()) == set(sql.oracle_sql())


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return int(value) if value.is_integer() else round(value, 6)
    return str(value) if not isinstance(value, (int, bool, str)) else value


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    ours = queries.queries()[name](spark, FOLDER)
    theirs = duck.sql(sql.oracle_sql()[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    key = lambda row: repr(row)
    a = sorted(([plain(r[c]) for c in columns] for r in ours.collect()), key=key)
    b = sorted(([plain(v) for v in row] for row in theirs.select(*[f'"{c}"' for c in columns]).fetchall()), key=key)
    assert a == b


ODD = ['"e1541c" The ednde', '"open', '""', '"a""b" c', "a\rb", "a \r", "a\r\nb", "a\x1fb", "a \n", "\n", "\t tab\t", "\u00a0\u3000wide\u2003", "", " ", None, "\ufeffmark", "🙂 é"]


def test_charset_utf16_of_odd_texts(spark, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").write.parquet(path)
    connection = duckdb.connect()
    connection.sql(f"create view documents as select * from '{path}/*.parquet'")
    theirs = connection.sql(sql.oracle_sql()["charset_utf16"]).fetchall()
    ours = queries.queries()["charset_utf16"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, ours))) == sorted(map(repr, theirs))


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert int(subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout) >= len(queries.queries())
