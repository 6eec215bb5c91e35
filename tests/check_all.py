"""Run every registered query against its DuckDB oracle and print a table.

    python tests/check_all.py /root/testdata/sf0.01 [key ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle_harness as H  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from shoplens.session import build_session  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = build_session("local[8]")
    con = H.duck(sf)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for k, fn in qs.items():
        if only and k not in only:
            continue
        t0 = time.time()
        try:
            r = H.compare(fn(spark, sf), sqls[k], con) if k in sqls else {"ok": None}
        except Exception as e:  # noqa: BLE001
            r = {"ok": False, "error": str(e)[:400]}
        dt = time.time() - t0
        if r.get("ok") is False:
            bad += 1
        print(f"{k:32s} {str(r.get('ok')):5s} {dt:6.1f}s "
              + ("" if r.get("ok") else json.dumps(r, default=str)[:1500]), flush=True)
    print("FAILED" if bad else "ALL OK", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
