"""The seventeen data types, their maps from source types and to target dialects, and identifiers."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Source type codes and names, and target type names.
PG_OID = {
    16: "Boolean", 17: "Bytes", 20: "Int64", 21: "Int16", 23: "Int32", 25: "String", 114: "Jsonb", 700: "Float32", 701: "Float64",
    1042: "String", 1043: "String", 1082: "Date", 1083: "Time", 1114: "Timestamp", 1184: "TimestampTz", 1266: "Time", 1700: "Decimal",
    2950: "Uuid", 3802: "Jsonb",
}
PG_ARRAY_OID = {1005: "int", 1007: "int", 1016: "int", 1021: "float", 1022: "float", 1009: "text", 1015: "text"}
MYSQL = {
    "TINYINT": "Int16", "SMALLINT": "Int16", "YEAR": "Int16", "MEDIUMINT": "Int32", "INT": "Int32", "BIGINT": "Int64", "FLOAT": "Float32",
    "DOUBLE": "Float64", "DECIMAL": "Decimal", "CHAR": "String", "VARCHAR": "String", "ENUM": "String", "SET": "String", "TEXT": "Text",
    "TINYTEXT": "Text", "MEDIUMTEXT": "Text", "LONGTEXT": "Text", "BINARY": "Bytes", "VARBINARY": "Bytes", "BLOB": "Bytes", "TINYBLOB": "Bytes",
    "MEDIUMBLOB": "Bytes", "LONGBLOB": "Bytes", "GEOMETRY": "Bytes", "POINT": "Bytes", "JSON": "Json", "DATE": "Date", "TIME": "Time",
    "DATETIME": "Timestamp", "TIMESTAMP": "TimestampTz", "BIT": "Bytes",
}
TARGET = {
    "postgres": {
        "Boolean": "boolean", "Int16": "smallint", "Int32": "integer", "Int64": "bigint", "Float32": "real", "Float64": "double precision",
        "Decimal": "numeric", "String": "text", "Text": "text", "Bytes": "bytea", "Json": "jsonb", "Jsonb": "jsonb", "Uuid": "uuid",
        "Date": "date", "Time": "time without time zone", "Timestamp": "timestamp without time zone", "TimestampTz": "timestamp with time zone",
    },
    "starrocks": {
        "Boolean": "BOOLEAN", "Int16": "SMALLINT", "Int32": "INT", "Int64": "BIGINT", "Float32": "FLOAT", "Float64": "DOUBLE",
        "Decimal": "DECIMAL", "String": "STRING", "Text": "STRING", "Bytes": "VARBINARY", "Json": "JSON", "Jsonb": "JSON", "Uuid": "STRING",
        "Date": "DATE", "Time": "STRING", "Timestamp": "DATETIME", "TimestampTz": "DATETIME",
    },
    "snowflake": {
        "Boolean": "BOOLEAN", "Int16": "SMALLINT", "Int32": "INT", "Int64": "BIGINT", "Float32": "FLOAT", "Float64": "DOUBLE",
        "Decimal": "NUMBER", "String": "VARCHAR", "Text": "VARCHAR", "Bytes": "BINARY", "Json": "VARIANT", "Jsonb": "VARIANT",
        "Uuid": "VARCHAR(36)", "Date": "DATE", "Time": "TIME", "Timestamp": "TIMESTAMP_NTZ", "TimestampTz": "TIMESTAMP_TZ",
    },
}
SPARK = {
    "Boolean": T.BooleanType(), "Int16": T.ShortType(), "Int32": T.IntegerType(), "Int64": T.LongType(), "Float32": T.FloatType(),
    "Float64": T.DoubleType(), "String": T.StringType(), "Text": T.StringType(), "Bytes": T.BinaryType(), "Json": T.StringType(),
    "Jsonb": T.StringType(), "Uuid": T.StringType(), "Date": T.DateType(), "Time": T.StringType(), "Timestamp": T.TimestampNTZType(),
    "TimestampTz": T.TimestampType(),
}


def clamp_decimal(precision: int, scale: int) -> tuple[int, int]:
    p = min(precision, 38)
    return p, min(scale, p)


def spark_type(name: str, precision: int = 38, scale: int = 9) -> T.DataType:
    return T.DecimalType(*clamp_decimal(precision, scale)) if name == "Decimal" else SPARK[name]


def target_type(dialect: str, name: str, precision: int = 38, scale: int = 9) -> str:
    out = TARGET[dialect][name]
    if name == "Decimal" and dialect != "postgres":
        return f"{out}({','.join(map(str, clamp_decimal(precision, scale)))})"
    return out


def from_pg(oid: int) -> str:
    return PG_OID.get(oid, "String")


def from_mysql(name: str) -> str:
    return MYSQL.get(re.sub(r"\(.*|\s.*", "", name.strip().upper()), "String")


def is_integer_key(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ShortType, T.IntegerType, T.LongType))


def quote(name: str, sign: str = "`") -> str:
    """Each dotted part quoted by itself."""
    return ".".join(f"{sign}{p.replace(sign, 2 * sign)}{sign}" for p in name.split("."))


_BARE, _QUOTED = re.compile(r"[A-Za-z_][A-Za-z0-9_$]*\Z"), re.compile(r'"[A-Za-z0-9_$ -]+"\Z')


def safe_identifier(name: str) -> bool:
    """One or two dotted parts, bare or in double quotes; no comment, no semicolon, spaces only inside quotes."""
    if not name or "--" in name or "/*" in name or ";" in name or name.count('"') % 2:
        return False
    parts = re.findall(r'"[^"]*"|[^.]+', name)
    return 1 <= len(parts) <= 2 and ".".join(parts) == name and all(_BARE.match(p) or _QUOTED.match(p) for p in parts)


def safe_identifier_column(x):
    """safe_identifier as a column expression."""
    part = r'([A-Za-z_][A-Za-z0-9_$]*|"[A-Za-z0-9_$ -]+")'
    return x.rlike(rf"^{part}(\.{part})?\z") & ~x.rlike(r"--|/\*|;")


def split_table(name: str, default: str = "public") -> tuple[str, str]:
    head, dot, tail = name.partition(".")
    return (head, tail) if dot else (default, name)
