"""Run registered queries against DuckDB on the same parquet files."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd


def connect(folder: str):
    con = duckdb.connect()
    for file in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(file)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{file}'")
    return con


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    columns = sorted(pdf.columns)

    def value(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
            return "∅"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, float) or type(v).__name__.startswith("float"):
            return repr(float(v))
        return str(v)

    return sorted(tuple(value(v) for v in row) for row in pdf[columns].itertuples(index=False, name=None))


def kinds(df_types: dict[str, str]) -> dict[str, str]:
    return dict(sorted(df_types.items()))


def diff(spark_rows, duck_rows, limit=3):
    from collections import Counter
    a, b = Counter(spark_rows), Counter(duck_rows)
    return list((a - b).items())[:limit], list((b - a).items())[:limit]


# Spark type -> DuckDB type with the same meaning.
SAME_TYPE = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP WITH TIME ZONE",
}


def check(spark, con, folder, name, fn, sql):
    """Problem text, or None when the rows agree."""
    df = fn(spark, folder)
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    if sql is None:
        return None if len(got.columns) else "no columns"
    rel = con.sql(sql)
    want = pd.DataFrame(rel.fetchall(), columns=rel.columns, dtype=object)
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    types = dict(zip(rel.columns, map(str, rel.types)))
    for c, t in df.dtypes:
        if SAME_TYPE.get(t) != types[c]:
            return f"type of {c}: {t} vs {types[c]}"
    a, b = canonical(got.astype(object)), canonical(want)
    if a != b:
        return f"{len(a)} vs {len(b)} rows; only spark / only sql: {diff(a, b)}"
    if not a:
        return "no rows"
    return None


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from docloom.session import build_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(folder), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            problem = check(spark, con, folder, name, fn, sqls.get(name))
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += problem is not None
        kind = "sql" if name in sqls else "rows"
        problem = problem and problem[:700]
        print(f"{'FAIL' if problem else 'ok':4} {kind:4} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
