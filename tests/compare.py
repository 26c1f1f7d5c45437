"""Runs registered queries beside their SQL and compares rows.

``python tests/compare.py [-d DIR] [NAME_PREFIX ...]`` prints one line per query.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from datetime import date, datetime
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (datetime, date, Decimal)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return str(v)


FAMILY = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
          "smallint": "SMALLINT", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "binary": "BLOB"}


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([repr([plain(r[i]) for i in order]) for r in rows])


def compare(df, con, sql):
    """None when equal, else a short text."""
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    desc = rel.description
    want_cols, want = rows_of([d[0] for d in desc], rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} / {want_cols}"
    kinds = dict(df.dtypes)
    other = {d[0]: str(d[1]) for d in desc}
    for c in got_cols:
        k = FAMILY.get(kinds[c])
        if k and other[c] not in (k, {"VARCHAR": "STRING", "BIGINT": "NUMBER"}.get(k)):
            return f"type of {c}: {kinds[c]} / {other[c]}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} rows differ, e.g. {bad[0][0][:300]} / {bad[0][1][:300]}" if bad else None


def main(argv):
    sf_dir = "/root/testdata/sf0.01"
    if argv[:1] == ["-d"]:
        sf_dir, argv = argv[1], argv[2:]
    import __spark_entry__ as entry
    from eventloom.session import build_session
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls, failed = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                why = compare(df, con, sqls[name])
                note = "ok" if why is None else "DIFF " + why
            else:
                note = f"rows {df.count()} (no SQL)"
        except Exception as e:  # report and go on
            note = "ERROR " + str(e).replace("\n", " ")[:600]
        failed += note.startswith(("DIFF", "ERROR"))
        print(f"{time.time() - t:6.2f} {name}: {note}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
