"""Hold a Spark result against DuckDB's."""

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).iterdir():
        con.execute(f"CREATE VIEW {path.name.split('.')[0]} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, Decimal):
        return float(f"{float(value):.9g}")
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return float(f"{value:.9g}") if abs(value) < 1e9 else value
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(df, con, sql):
    """None if columns and rows agree, else what doesn't."""
    result = con.execute(sql)
    names, theirs = rows_of(result.fetchall(), [d[0] for d in result.description])
    mine_names, mine = rows_of([tuple(r) for r in df.collect()], df.columns)
    if names != mine_names:
        return f"columns {mine_names} and {names}"
    if mine != theirs:
        return f"{sum(mine.values())} and {sum(theirs.values())} rows; only here {list((mine - theirs).items())[:3]}; only there {list((theirs - mine).items())[:3]}"
    return None
