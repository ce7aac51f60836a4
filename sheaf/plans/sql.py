"""The queries' results in DuckDB SQL."""

from __future__ import annotations

from sheaf.plans import queries as Q

QUOTED = "replace(text, ' the ', ' \"the\", ')"
ESCAPED = f"CASE WHEN {{0}} THEN '\"' || replace({QUOTED}, '\"', '\"\"') || '\"' ELSE {QUOTED} END"
NEEDS = f"(contains({QUOTED}, ',') OR contains({QUOTED}, '\"') OR contains({QUOTED}, chr(10)) OR contains({QUOTED}, chr(13)))"
DAY = "date_trunc('day', o_orderdate)::TIMESTAMP"
CAMEL = 'SELECT c_custkey AS "custKey", c_name AS "fullName", c_acctbal AS "accountBalance" FROM customer'
NATION = "SELECT c_custkey, n_name AS nation_name, n_regionkey AS region FROM customer JOIN nation ON c_nationkey = n_nationkey"


def _token(key: str, tokens: tuple[str, ...]) -> str:
    return "([" + ", ".join("'" + t + "'" for t in tokens) + f"])[{key} % {len(tokens)} + 1]"


def _values(table: str, key: str, tokens: tuple[str, ...], results: tuple[str, ...]) -> str:
    return f"SELECT {key}, ([{', '.join(results)}])[{key} % {len(tokens)} + 1] AS v FROM {table}"


def _row(d: str, *columns: str) -> str:
    return f" || '{d}' || ".join(columns)


def _number(name: str = "v") -> str:
    return f"SELECT o_orderkey, round(o_totalprice, 2) AS {name} FROM orders"


_DATE = f"SELECT o_orderkey, {DAY} AS v FROM orders"
#: A double as written: shortest digits, with .0 where it is whole.
_BALANCE = "c_acctbal::VARCHAR"
_BAD = "c_custkey % 7 = 0"

SQL: dict[str, str] = {
    "flagship_filter_aggregate": "SELECT o_orderpriority, count(*) AS n_orders, round(sum(o_totalprice::DECIMAL(20,4)), 2)::DOUBLE AS revenue FROM orders WHERE o_orderstatus = 'O' GROUP BY o_orderpriority",
    **{f"roundtrip_{t}": f"SELECT * FROM {t}" for t in Q.TABLES},
    "roundtrip_lines": "SELECT * FROM lineitem",
    "roundtrip_native": "SELECT * FROM lineitem",
    "roundtrip_quoted": f"SELECT doc_id, '\"' || replace({QUOTED}, chr(10), chr(13) || chr(10)) || chr(13) AS text FROM documents",
    "wide_read": "SELECT " + ", ".join(f"'value{i}_' || c_custkey AS col{i}" for i in (0, 7, 21, 34, 49)) + " FROM customer",
    "mixed_map_reencode": "SELECT upper(c_name) || ',' || (c_custkey + 1) || ',' || (c_nationkey * 0.5)::DOUBLE::VARCHAR AS row FROM customer",
    "escape_text": f"SELECT doc_id, {NEEDS} AS quoted, {ESCAPED.format(NEEDS)} AS field FROM documents",
    "unescape_text": f"SELECT doc_id, {QUOTED} AS field FROM documents",
    "encode_row": f"SELECT {_row(',', 'c_custkey', 'c_name', 'c_nationkey', _BALANCE)} AS row FROM customer",
    "encode_semicolon": f"SELECT {_row(';', 'c_custkey', 'c_name', 'c_nationkey', _BALANCE)} AS row FROM customer",
    "encode_lines_crlf": "SELECT n_nationkey || ',' || n_name || ',' || n_regionkey || chr(13) || chr(10) AS line FROM nation",
    "encode_dictionary": "SELECT 'n_nationkey' AS key, n_nationkey::VARCHAR AS value FROM nation UNION ALL SELECT 'n_name', n_name FROM nation UNION ALL SELECT 'n_regionkey', n_regionkey::VARCHAR FROM nation",
    "encode_headers": "SELECT r_regionkey, 'CUSTOMER_ID,ACCOUNT_BALANCE,MARKET_SEGMENT' AS header FROM region",
    "raw_records": "SELECT n_regionkey::VARCHAR AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS row, 3::BIGINT AS width, n_name AS name, true AS beyond FROM nation",
    "record_split_count": "SELECT doc_id, len(string_split(regexp_replace(text, '\\n+$', ''), chr(10)))::BIGINT AS n_records FROM documents WHERE text IS NOT NULL AND length(regexp_replace(text, '\\n+$', '')) > 0",
    "field_count_histogram": "SELECT width, count(*) AS n_records FROM (SELECT len(string_split(r, ','))::BIGINT AS width FROM (SELECT unnest(string_split(regexp_replace(text, '\\n+$', ''), chr(10))) AS r FROM documents WHERE length(regexp_replace(text, '\\n+$', '')) > 0)) GROUP BY width",
    "approximate_rows": "SELECT sum(length(text) - length(replace(text, chr(10), '')))::BIGINT AS lines FROM documents",
    "trim_fields": "SELECT n_nationkey::BIGINT AS n_nationkey, n_name AS v FROM nation",
    "charset_utf16": "SELECT trim(replace(text, chr(10), ' ')) AS text FROM documents",
    "charset_latin1": "SELECT n_nationkey, n_name || 'é' AS name FROM nation",
    "bool_standard": _values("customer", "c_custkey", Q.STANDARD_TOKENS, ("true", "false", "true", "false", "true", "false", "true", "false")),
    "bool_flexible": _values("customer", "c_custkey", Q.FLEXIBLE_TOKENS, ("true", "false", "true", "false", "true", "false", "true", "false")),
    "bool_custom": _values("customer", "c_custkey", Q.CUSTOM_TOKENS, ("true", "false", "true", "false")),
    "bool_encode_numeric": "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN '1' ELSE '0' END AS v FROM customer",
    "bool_encode_true_false": "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END AS v FROM customer",
    "bool_encode_yes_no": "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'yes' ELSE 'no' END AS v FROM customer",
    "int_range_check": "SELECT c_custkey, CASE WHEN c_custkey <= 127 THEN c_custkey END AS v, c_custkey > 127 AS bad FROM customer",
    "int_refuses_decimals": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN c_custkey END AS v, CASE WHEN c_custkey % 3 <> 1 THEN 'Value appears to be a decimal. Use Double or Decimal type, or check for locale-specific formatting' END AS suggestion FROM customer",
    "unsigned_decode": "SELECT c_custkey, CASE WHEN c_custkey - 100 BETWEEN 0 AND 255 THEN c_custkey - 100 END AS v FROM customer",
    **{f"number_{n}": _number() for n in ("standard", "flexible_us", "flexible_eu", "currency", "currency_after", "units", "locale_de", "locale_fr", "parsed_us")},
    "decimal_exact": "SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS cents FROM orders",
    "number_encode_locale": "SELECT p_partkey, replace(format('{:,}', round(p_retailprice * 1000)::BIGINT), ',', '.') AS v FROM part",
    "number_encode_plain": "SELECT p_partkey, (p_partkey * 12345678)::VARCHAR || '.0' AS v FROM part",
    **{f"date_{n}": _DATE for n in ("iso", "epoch_s", "epoch_ms", "formatted", "flexible", "hint", "locale_us", "locale_gb", "locale_de_long", "custom")},
    "date_day_first": "SELECT n_nationkey::BIGINT AS n_nationkey, make_timestamp(2024, 2, n_nationkey % 12 + 1, 0, 0, 0) AS v FROM nation",
    "date_encode_iso": f"SELECT o_orderkey, strftime({DAY}, '%Y-%m-%dT%H:%M:%SZ') AS v FROM orders",
    "date_encode_seconds": f"SELECT o_orderkey, epoch({DAY})::BIGINT || '.0' AS v FROM orders",
    "date_encode_millis": f"SELECT o_orderkey, epoch_ms({DAY}) || '.0' AS v FROM orders",
    "date_encode_formatted": f"SELECT o_orderkey, strftime({DAY}, '%d.%m.%Y') AS v FROM orders",
    "nil_empty": f"SELECT c_custkey, nullif({_token('c_custkey', Q.NIL_TOKENS)}, '') AS v FROM customer",
    "nil_literal": f"SELECT c_custkey, CASE WHEN lower({_token('c_custkey', Q.NIL_TOKENS)}) NOT IN ('', 'null') THEN {_token('c_custkey', Q.NIL_TOKENS)} END AS v FROM customer",
    "nil_custom": f"SELECT c_custkey, CASE WHEN {_token('c_custkey', Q.NIL_TOKENS)} NOT IN ('', 'N/A', '-') THEN {_token('c_custkey', Q.NIL_TOKENS)} END AS v FROM customer",
    **{f"nil_encode_{n}": f"SELECT c_custkey || ',' || CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '{t}' END AS row FROM customer" for n, t in (("empty", ""), ("literal", "null"), ("custom", "N/A"))},
    "uuid_decode": "SELECT c_custkey, upper(h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32]) AS v FROM (SELECT c_custkey, md5(c_custkey::VARCHAR) AS h FROM customer)",
    "url_decode": "SELECT page_id, url AS v FROM pages WHERE url IS NOT NULL",
    **{f"keys_{n}": CAMEL for n in ("default", "snake", "kebab", "screaming", "pascal", "custom")},
    "column_mapping": CAMEL,
    "index_mapping": CAMEL,
    "indexed_schema": CAMEL,
    **{f"keys_encode_{n}": f"SELECT '{a}' AS key, n_nationkey::VARCHAR AS value FROM nation UNION ALL SELECT '{b}', n_name FROM nation" for n, a, b in (("snake", "nation_key", "full_name"), ("kebab", "nation-key", "full-name"), ("screaming", "NATION_KEY", "FULL_NAME"))},
    "nested_flatten": NATION,
    "nested_json": NATION,
    "nested_json_encode": "SELECT n_nationkey || ',\"{\"\"name\"\":\"\"' || n_name || '\"\",\"\"region\"\":' || n_regionkey || '}\"' AS row FROM nation",
    "nested_array_json": "SELECT vec_id, len(embedding)::BIGINT AS width, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings",
    "error_rows": f"SELECT c_custkey, {_BAD} AS bad, CASE WHEN NOT {_BAD} THEN round(c_acctbal, 2) END AS balance FROM customer",
    "error_locations": (
        "SELECT c_custkey, 'typeMismatch' AS kind, row, 'balance' AS \"column\", 'Double' AS expected, 'n/a' AS actual, "
        "'Type mismatch: expected Double, found ''n/a'' at row ' || row || ', column ''balance''' AS message "
        f"FROM (SELECT c_custkey, 1 + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS row FROM customer) WHERE {_BAD}"
    ),
    "suggest_keys": "SELECT 2::BIGINT AS row, 'Key ''name'' not found in CSV row at row 2, column ''name''. Did you mean ''naame''?' AS message FROM nation",
    "key_distance": "SELECT n_nationkey, levenshtein(lower(n_name), 'germany') AS distance FROM nation",
    "strict_field_count": "SELECT n_nationkey::BIGINT AS a, CASE WHEN n_nationkey % 3 = 0 THEN 'Parsing error: Expected 2 fields at line 2' END AS message FROM nation",
    "strict_quotes": "SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'say \"' || n_name || '\"' ELSE n_name END AS a, n_nationkey % 2 = 0 AS bad FROM nation",
    "unterminated": "SELECT n_nationkey % 5 = 0 AS bad, count(*) AS n FROM nation GROUP BY 1",
    "decode_batches": "SELECT ((row - 1) // 25)::BIGINT AS _batch, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS row FROM customer) GROUP BY 1",
    "encode_batches": "SELECT (n // 100)::BIGINT AS batch, count(*) AS n, min_by(c_custkey || ',' || c_name, n) AS first FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS n FROM customer) GROUP BY 1",
    "stream_decode": "SELECT * FROM nation",
    "stream_encode": "SELECT c_custkey, c_name, c_acctbal FROM customer",
    "progress_counts": "SELECT count(*) AS rows, sum(strlen(n_nationkey || ',' || n_name || ',' || n_regionkey) + 1)::BIGINT AS bytes FROM nation",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
