"""Spark result and oracle SQL side by side."""

import math
import os

import duckdb


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def differ(spark, sf, query, sql):
    """None if equal, else a short account."""
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    rel = con.sql(sql)
    want_names, want = rel.columns, rel.fetchall()
    df = query(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = rows(want_names, want)
    if sorted(df.columns) != sorted(want_names):
        return f"columns {sorted(df.columns)} / {sorted(want_names)}"
    if len(got) != len(want):
        return f"{len(got)} rows, wanted {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(want)}: {str(bad[:2])[:600]}" if bad else None
