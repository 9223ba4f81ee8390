"""Run registered queries next to their SQL and compare whole results.

``python -m tests.oracle [folder] [names...]`` prints one line per query.
"""
import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_value(x) for x in v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, query, sql):
    """Message about the first difference, or None."""
    df = query(spark, folder)
    have_cols, have = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want_cols, want = _rows([d[0] for d in result.description], result.fetchall())
    if have_cols != want_cols:
        return f"columns {have_cols} != {want_cols}"
    if len(have) != len(want):
        return f"{len(have)} rows, expected {len(want)}; e.g. {set(have) ^ set(want) and sorted(set(have) ^ set(want), key=repr)[:2]}"
    for a, b in zip(have, want):
        if a != b:
            return f"{a!r}\n   != {b!r}"
    kinds = [(c, type(x), type(y)) for c, x, y in zip(have_cols, have[0], want[0]) if type(x) is not type(y)] if have else []
    return f"types {kinds}" if kinds else None


def main(argv):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from docmill.session import local_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session(8, **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    con = connect(folder)
    sqls = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        begin = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, folder, query, sqls[name])
                note = "ok" if problem is None else "DIFF " + problem[:1500]
            else:
                note = f"rows {query(spark, folder).count()}"
        except Exception as failure:
            note = "FAIL " + str(failure)[:1500]
        bad += note.startswith(("DIFF", "FAIL"))
        print(f"{name:28s} {time.time() - begin:6.1f}s {note}", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
