"""Comparing two results as multisets of rows."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb
import pandas as pd


def views(con: duckdb.DuckDBPyConnection, sf: str) -> None:
    con.sql("SET TimeZone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE OR REPLACE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")


def plain(x):
    if isinstance(x, (list, tuple)) or hasattr(x, "tolist") and getattr(x, "ndim", 0):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if x is None or x is pd.NaT or isinstance(x, float) and math.isnan(x) or x is pd.NA:
        return None
    if isinstance(x, (bool, str, bytes)) or type(x).__name__ == "bool_":
        return bool(x) if type(x).__name__ == "bool_" else x
    if isinstance(x, (pd.Timestamp, datetime, date)):
        at = pd.Timestamp(x)
        return str(at.tz_localize(None) if at.tzinfo else at)
    if isinstance(x, (int, float, Decimal)) or hasattr(x, "item"):
        return round(float(x), 4)
    return str(x)


def rows(df: pd.DataFrame) -> Counter:
    columns = sorted(df.columns)
    return Counter(zip(*[[plain(v) for v in df[c].tolist()] for c in columns], strict=True)) if len(df) else Counter()


def same(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """What differs, or nothing."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a == b:
        return ""
    return f"{len(got)} and {len(want)} rows; only here {list((a - b).items())[:3]}, only in SQL {list((b - a).items())[:3]}"
