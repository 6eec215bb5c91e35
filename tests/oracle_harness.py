"""Spark-vs-DuckDB comparison used by the tests (and handy from a shell).

Mirrors the driver's gate: same column names, same row count, and the same
multiset of rows after sorting columns by name.  Floats are compared after
rounding to 9 significant digits so that the check is about values, not
about the last bit of a double.
"""

from __future__ import annotations

import datetime as _dt
import os
import math

import duckdb
import pandas as pd

EXACT = bool(int(os.environ.get("ORACLE_EXACT", "0")))

VIEWS = ("region nation customer supplier part orders lineitem events documents "
         "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for v in VIEWS:
        con.execute(f"CREATE VIEW {v} AS SELECT * FROM read_parquet('{sf_dir}/{v}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v == int(v) and abs(v) < 2 ** 53:
            return int(v)
        return v if EXACT else float(f"{v:.9g}")
    if isinstance(v, _dt.datetime):
        if (v.hour, v.minute, v.second, v.microsecond) == (0, 0, 0, 0):
            return v.date().isoformat()
        return v.isoformat(sep=" ")
    if isinstance(v, _dt.date):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, pd.Timestamp):
        return v.date().isoformat() if v == v.normalize() else v.isoformat(sep=" ")
    return v


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    pdf = pdf[cols].astype(object).where(pdf[cols].notna(), None)
    out = [tuple(_norm(v) for v in r) for r in pdf.itertuples(index=False, name=None)]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0)
                                           for x in t))


def compare(spark_df, sql: str, con) -> dict:
    s = spark_df.toPandas()
    d = con.execute(sql).df()
    res = {"spark_rows": len(s), "oracle_rows": len(d),
           "spark_cols": sorted(s.columns), "oracle_cols": sorted(d.columns)}
    res["cols_match"] = res["spark_cols"] == res["oracle_cols"]
    if not res["cols_match"]:
        res["ok"] = False
        return res
    rs, rd = rows_of(s), rows_of(d)
    res["rows_match"] = len(rs) == len(rd)
    res["values_match"] = rs == rd
    if not res["values_match"]:
        from collections import Counter
        cs, cd = Counter(rs), Counter(rd)
        diff_s = list((cs - cd).elements())[:3]
        diff_d = list((cd - cs).elements())[:3]
        res["sample_spark_only"] = diff_s
        res["sample_oracle_only"] = diff_d
    res["ok"] = res["rows_match"] and res["values_match"]
    return res
