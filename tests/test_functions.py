"""Scalar functions, types and identifiers."""

import pytest
from pyspark.sql import functions as F

from changeloom.functions import scalar, types


def values(spark, texts, expr):
    return [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "n int, x string").orderBy("n").select(expr).collect()]


def test_bool(spark):
    assert values(spark, ["t", "TRUE", "1", "f", "yes", None], scalar.pg_bool(F.col("x"))) == [True, True, True, False, False, None]


def test_money(spark):
    assert values(spark, ["$1,234.56", "€99,95", "1.234,56", "-$5"], scalar.strip_money(F.col("x"))) == ["1234.56", "99.95", "1.23456", "-5"]
    assert values(spark, ["1.234,56"], scalar.strip_money(F.col("x"), decimal_comma=True)) == ["1234.56"]
    assert values(spark, ["$1,234"], scalar.strip_money(F.col("x"), decimal_comma=False)) == ["1234"]


def test_times(spark):
    assert values(spark, ["2024-06-15 17:30:00+05:30", "2024-06-15 17:30:00.5+00", "2024-06-15 17:30:00", "soon"], scalar.normalize_tstz(F.col("x"))) == ["2024-06-15 12:00:00", "2024-06-15 17:30:00.500000", "2024-06-15 17:30:00", "soon"]
    assert values(spark, ["1778368097"], scalar.epoch_text(F.col("x"))) == ["2026-05-09 23:08:17"]
    assert values(spark, ["-1500000", "0"], scalar.micros_text(F.col("x").cast("long"))) == ["1969-12-31 23:59:58.500000", "1970-01-01 00:00:00.000000"]


@pytest.mark.parametrize(
    "text,kind,want",
    [("{}", "int", "[]"), ("{NULL,1,2}", "int", "[null,1,2]"), ("{NaN,1.5}", "float", '["NaN",1.5]'), ('{"a,b","c\\"d"}', "text", '["a,b","c\\"d"]'), ("x", "text", '"x"'), ('{"NULL"}', "text", '["NULL"]'), (None, "int", None)],
)
def test_arrays(text, kind, want):
    assert scalar.parse_pg_array(text, kind) == want


def test_positions(spark):
    n = scalar.lsn_number(F.col("x"))
    assert values(spark, ["FFFFFFFF/FFFFFFFF", "16/B374D848"], scalar.lsn_text(n)) == ["FFFFFFFF/FFFFFFFF", "16/B374D848"]
    rows = spark.createDataFrame([("lsn", 5, "lsn", 4), ("lsn", 5, "offset", 4), ("gtid", 5, "gtid", 4)], "ka string, a long, kb string, b long")
    assert [r[0] for r in rows.select(scalar.position_ahead(F.col("ka"), F.col("a"), F.col("kb"), F.col("b"))).collect()] == [True, None, None]


def test_versions_and_properties(spark):
    assert values(spark, ["3.2.1-abc", "3.1", "4.0", "none"], scalar.version_at_least(F.col("x"), 3, 2)) == [True, False, True, None]
    assert values(spark, ['"a" = "TRUE"', "A : true", "a=false"], scalar.has_property(F.col("x"), "a", "true")) == [True, True, False]


def test_images(spark):
    rows = spark.createDataFrame([(1, None, ["big"])], "id int, big string, u array<string>")
    assert rows.select(scalar.image_json(["id", "big"])).first()[0] == '{"id":1,"big":null}'
    assert rows.select(scalar.image_json(["id", "big"], F.col("u"))).first()[0] == '{"id":1}'


def test_types():
    assert types.target_type("snowflake", "Decimal", 50, 60) == "NUMBER(38,38)"
    assert types.target_type("starrocks", "Json") == "JSON" and types.from_mysql("decimal(10,2) unsigned") == "Decimal" and types.from_mysql("what") == "String"
    assert all(set(m) == set(types.SPARK) | {"Decimal"} for m in types.TARGET.values())


@pytest.mark.parametrize("name,ok", [("public.orders", True), ('"My Table"', True), ("users; DROP TABLE users--", False), ("users ", False), ("", False), ('"a', False), ("a.b.c", False)])
def test_identifiers(name, ok):
    assert types.safe_identifier(name) is ok


def test_quoting():
    assert types.quote("a.b`c") == "`a`.`b``c`" and types.split_table("x") == ("public", "x") and types.split_table("s.x") == ("s", "x")


def test_identifier_column_is_the_function(spark):
    from changeloom.functions import types

    names = ["orders", "public.orders", '"My Table"', 'a."b c"', "users; DROP TABLE users--", "users ", "", "a.b.c", 'a"b', "1a", "a/*b", '"a--b"', '"a""b"', "a\n", "."]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.ok for r in rows.select("n", types.safe_identifier_column(rows.n).alias("ok")).collect()}
    assert got == {n: types.safe_identifier(n) for n in names} and sum(got.values()) == 4
