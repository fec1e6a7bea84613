"""Holds registered queries against their SQL, in DuckDB, on the driver's tables."""

from __future__ import annotations

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i].lower())
    fix = lambda v: None if v is None else f"{v + 0.0:.4f}" if isinstance(v, float) else str(v)
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=str)


def differences(spark, sf_dir, name, query, sql):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    got = query(spark, sf_dir)
    rel = con.sql(sql)
    a, b = norm([tuple(r) for r in got.collect()], got.columns), norm(rel.fetchall(), rel.columns)
    if sorted(map(str.lower, got.columns)) != sorted(map(str.lower, rel.columns)):
        return f"columns {got.columns} {rel.columns}"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b, strict=False) if x != y][:2]
        return f"{len(a)} and {len(b)} rows, {bad}"
    return ""


