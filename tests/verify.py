"""Compare queries with their SQL as the driver does: python tests/verify.py SF_DIR [NAME...]."""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{src}')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        if isinstance(x, float):
            return float(f"{x:.9g}")
        return x.item() if hasattr(x, "item") and not hasattr(x, "isoformat") else x

    return sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a != b:
        x, y = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
        return f"{len(a)} and {len(b)} rows; only Spark {x}; only SQL {y}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as e
    from tierline.session import local_session

    spark, con = local_session(8), connect(sys.argv[1])
    q, s = e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or q:
        began = time.time()
        bad = compare(spark, con, q[name], s[name], sys.argv[1]) if name in s else f"rows only: {q[name](spark, sys.argv[1]).count()}"
        print(f"{name}: {bad or 'ok'} ({time.time() - began:.1f} s)", flush=True)
