"""CLI: python tests/check_oracle.py [sf_dir] [name ...] -- compare Spark jobs with their oracle SQL."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from riskweave.session import local_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = local_session()
    qs, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or list(qs):
        t0 = time.time()
        try:
            s = qs[name](spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        if name not in sql:
            print(f"ROWS  {name}: {len(s)} rows (no oracle) {time.time() - t0:.1f}s")
            continue
        try:
            d = duck(sql[name], sf)
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {name}: duckdb error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        p = compare(s, d)
        print(("OK    " if not p else "FAIL  ") + f"{name}: {len(s)} rows {time.time() - t0:.1f}s " + "; ".join(p))
        bad += bool(p)
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
