"""Compare registered queries with their SQL on DuckDB."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(path: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(path, t)}.parquet'")
    return con


def _cell(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if hasattr(v, "item"):
        return _cell(v.item())
    if hasattr(v, "tolist"):
        return tuple(_cell(x) for x in v.tolist())
    return v


def rows(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    return sorted((tuple(_cell(v) for v in r) for r in pdf.itertuples(index=False, name=None)), key=repr)


def kinds(pdf: pd.DataFrame) -> dict:
    return {c: str(pdf[c].dtype) for c in sorted(pdf.columns)}


def compare(spark_pdf: pd.DataFrame, sql_pdf: pd.DataFrame) -> str | None:
    if sorted(spark_pdf.columns) != sorted(sql_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} != {sorted(sql_pdf.columns)}"
    a, b = rows(spark_pdf), rows(sql_pdf)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first: {bad[0]}"
    if kinds(spark_pdf) != kinds(sql_pdf):
        diff = {c: (k, kinds(sql_pdf)[c]) for c, k in kinds(spark_pdf).items() if kinds(sql_pdf)[c] != k}
        return f"TYPES {diff}"
    return None


def main(path: str, names: list[str]) -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from threatspark.session import build_session

    spark = build_session("8")
    con = connect(path)
    queries, sql = entry.queries(), entry.oracle_sql()
    chosen = [n for n in queries if not names or any(p in n for p in names)]
    good = 0
    for n in chosen:
        t0 = time.time()
        try:
            got = queries[n](spark, path).toPandas()
            t1 = time.time()
            if n in sql:
                message = compare(got, con.execute(sql[n]).df())
            else:
                message = None if len(got) else "no rows"
        except Exception as exc:  # noqa: BLE001
            message, t1, got = f"{type(exc).__name__}: {str(exc)[:1500]}", time.time(), []
        good += message is None
        mark = "ok" if message is None else "BAD"
        print(f"{mark:4}{n:40}{len(got):8} rows {t1 - t0:6.2f}s sql {time.time() - t1:6.2f}s {'' if n in sql else '(rows only)'} {message or ''}", flush=True)
    print(f"{good}/{len(chosen)} good")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
