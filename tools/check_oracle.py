"""Run registered queries in Spark and their oracle SQL in DuckDB; print one
line per query. Usage: python tools/check_oracle.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from verdant.plans.catalog import ORACLE, QUERIES  # noqa: E402
from verdant.plans.compare import compare, duck_connect, type_mismatches  # noqa: E402
from verdant.session import get_session  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = get_session("local[8]", 8)
    con = duck_connect(sf_dir)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLE:
                r = compare(df, ORACLE[name], con, exact=True)
                status = "OK " if r["ok"] else "BAD"
                bad += not r["ok"]
                extra = "" if r["ok"] else f" {r}"
                tm = type_mismatches(df, ORACLE[name], con)
                if tm:
                    extra += f" TYPES {tm}"
                if r.get("exact_diffs"):
                    extra += f" EXACT_FLOAT_DIFFS {r['exact_diffs']}"
                print(f"{status} {name}: rows {r['spark_rows']}/{r['oracle_rows']} "
                      f"{time.time() - t0:.1f}s{extra}", flush=True)
            else:
                n = df.count()
                print(f"--- {name}: rows {n} (no oracle) {time.time() - t0:.1f}s", flush=True)
        except Exception:
            bad += 1
            print(f"ERR {name}:\n{traceback.format_exc()[-3000:]}", flush=True)
    print(f"done, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
