"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math


def _norm(v, places: int | None = 5):
    """``places=None`` compares doubles exactly (only -0.0 and 0.0 are equal)."""
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return (v if places is None else round(v, places)) + 0.0
    if hasattr(v, "isoformat"):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, places) for x in v)
    return v


def canonical(cols, records, places: int | None = 5):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    out = [tuple(_norm(r[k], places) for k in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def duckdb_connection(sf_dir: str):
    import duckdb

    from fedtab.session import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


SPARK_TO_DUCK = {
    "IntegerType": "INTEGER", "LongType": "BIGINT", "DoubleType": "DOUBLE", "StringType": "VARCHAR",
    "BooleanType": "BOOLEAN", "TimestampType": "TIMESTAMP WITH TIME ZONE", "TimestampNTZType": "TIMESTAMP",
    "FloatType": "FLOAT", "ShortType": "SMALLINT", "ByteType": "TINYINT", "DateType": "DATE",
}


def spark_type_name(dt) -> str:
    name = type(dt).__name__
    if name == "ArrayType":
        return spark_type_name(dt.elementType) + "[]"
    return SPARK_TO_DUCK.get(name, name)


def compare(spark_df, con, sql: str, check_types: bool = True, places: int | None = 5) -> tuple[bool, str]:
    scols = spark_df.columns
    stypes = {f.name: spark_type_name(f.dataType) for f in spark_df.schema.fields}
    srows = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    dcols, drows = rel.columns, rel.fetchall()
    dtypes = dict(zip(dcols, [str(t) for t in rel.types]))
    if sorted(scols) != sorted(dcols):
        return False, f"columns {sorted(scols)} vs {sorted(dcols)}"
    if check_types:
        bad = {c: (stypes[c], dtypes[c]) for c in scols if stypes[c] != dtypes[c]}
        if bad:
            return False, f"types differ {bad}"
    a, b = canonical(scols, srows, places), canonical(dcols, drows, places)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"rows {len(a)} vs {len(b)}; first diffs {diff}"
    return True, f"{len(a)} rows"
