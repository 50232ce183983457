"""Compare a query with its DuckDB counterpart: names, kinds of types, rows whatever their order."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else (int(x) if x == int(x) and abs(x) < 1e15 else float(f"{x:.12g}"))
    if isinstance(x, dt.datetime):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    return x


def normal(rows, order):
    return sorted((repr([plain(r[i]) for i in order]) for r in rows))


def kind(name):
    n = str(name).lower()
    for k, words in (("int64", ("bigint", "long")), ("int32", ("int",)), ("float", ("double", "float", "decimal")), ("text", ("string", "varchar")),
                     ("date", ("date",)), ("time", ("timestamp",)), ("bool", ("bool",))):
        if any(n.startswith(w) or n.startswith("u" + w) for w in words) and "[" not in n:
            return k
    return "other"


def compare(df, con, sql):
    """None when equal, else what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = [kind(d[1]) for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got = [tuple(r) for r in df.collect()]
    by = dict(zip(df.columns, [kind(f.dataType.simpleString()) for f in df.schema.fields]))
    for n, t in zip(names, types):
        if by[n] != t:
            return f"type of {n}: {by[n]} != {t}"
    g = normal(got, [df.columns.index(n) for n in sorted(names)])
    w = normal(want, [names.index(n) for n in sorted(names)])
    if g != w:
        gs, ws = set(g), set(w)
        return f"rows {len(g)} vs {len(w)}; only here {sorted(gs - ws)[:3]}; only there {sorted(ws - gs)[:3]}"
    return None
