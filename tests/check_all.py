"""Runs every registered query against its SQL: python tests/check_all.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries
from panelweave.session import local_session
from tests.compare import connect, differences

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:]
    spark, con, bad = local_session("check"), connect(sf), 0
    for name, fn in queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            sql = oracle_sql().get(name)
            if sql:
                found = differences(df, con, sql)
                note = "ok" if not found else "; ".join(found)
                rows = df.count() if not found and names else ""
            else:
                rows, found, note = df.count(), [], "rows only"
        except Exception as err:
            found, note, rows = [1], f"ERROR {str(err)[:600]}", ""
            if names:
                traceback.print_exc()
        bad += bool(found)
        print(f"{name:26s} {time.time() - t:6.1f}s {rows} {note}", flush=True)
    print("unchecked SQL keys:", set(oracle_sql()) - set(queries()), "failed:", bad)
