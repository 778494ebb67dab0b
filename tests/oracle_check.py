"""Runs registered queries beside their plain-SQL twins and compares names, rows and values.

    python tests/oracle_check.py [sf_dir] [name ...]
"""
from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.12g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def kind(v):
    return {bool: "bool", int: "int", float: "float", decimal.Decimal: "decimal", str: "str", list: "list", tuple: "list"}.get(type(v), type(v).__name__)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, build, sql, sf_dir):
    """Empty list when both sides agree, else what differs."""
    df = build(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want = cur.fetchall()
    problems = []
    if sorted(df.columns) != sorted(want_names):
        return [f"columns {sorted(df.columns)} != {sorted(want_names)}"]
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    if got and want:
        for c in df.columns:
            ours = {kind(r[df.columns.index(c)]) for r in got[:200]} - {"NoneType"}
            theirs = {kind(r[want_names.index(c)]) for r in want[:200]} - {"NoneType"}
            if ours and theirs and ours != theirs:
                problems.append(f"type of {c}: {ours} != {theirs}")
    a, b = rows_of(df.columns, got), rows_of(want_names, want)
    if a != b:
        sa, sb = set(map(repr, a)), set(map(repr, b))
        only_a, only_b = sorted(sa - sb), sorted(sb - sa)
        problems.append(f"values differ: {len(only_a)} only here, {len(only_b)} only in SQL; columns {sorted(df.columns)}")
        problems += [f"  here {x}"[:400] for x in only_a[:3]] + [f"  SQL  {x}"[:400] for x in only_b[:3]]
    return problems


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    import __spark_entry__ as entry
    from tallyforge.session import get_session

    spark = get_session("check", cpus=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv[1:] or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv[1:])]
    bad = 0
    for name in names:
        started = time.time()
        try:
            if name in oracle:
                problems = compare(spark, con, name, queries[name], oracle[name], sf_dir)
                note = ""
            else:
                n = len(queries[name](spark, sf_dir).collect())
                problems, note = ([] if n else ["no rows"]), f" rows only: {n}"
        except Exception as e:  # noqa: BLE001
            problems, note = [f"{type(e).__name__}: {str(e)[:700]}"], ""
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - started:.1f}s{note}", flush=True)
        for p in problems:
            print("     ", p, flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
