"""Compares registered queries with their SQL, as value sets over columns sorted by name."""

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql, sf_dir):
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    r = c.execute(sql)
    return [d[0] for d in r.description], r.fetchall()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if hasattr(v, "tzinfo") and v.tzinfo:
        return v.replace(tzinfo=None)
    return v if not hasattr(v, "as_tuple") else round(float(v), 5)


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(df, sql, sf_dir):
    """None where both agree, else a line that says how they don't."""
    names, rows = sql_rows(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    mine, theirs = bag(df.columns, [tuple(r) for r in df.collect()]), bag(names, rows)
    if mine != theirs:
        return f"{sum(mine.values())} and {sum(theirs.values())} rows; only here {list((mine - theirs).items())[:2]}; only in SQL {list((theirs - mine).items())[:2]}"
    return None
