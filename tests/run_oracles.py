"""python tests/run_oracles.py DIR [NAME...]: every query with SQL against DuckDB, others for rows only."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from harness import compare  # noqa: E402

from querymill.session import build_session  # noqa: E402

if __name__ == "__main__":
    d, names = sys.argv[1], sys.argv[2:]
    spark = build_session(f"local[{os.environ.get('CPUS', '4')}]", 8)
    qs, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, f in qs.items():
        if names and name not in names and not any(n.endswith("*") and name.startswith(n[:-1]) for n in names):
            continue
        t = time.time()
        try:
            why = compare(spark, d, f, sql[name]) if name in sql else (None, f(spark, d).count())[0]
        except Exception as e:  # noqa: BLE001
            why = f"{type(e).__name__}: {str(e)[:400]}"
        bad += why is not None
        if why or time.time() - t > 20 or names:
            print(f"{name}: {why or 'ok'} ({time.time() - t:.1f} s{'' if name in sql else ', no SQL'})", flush=True)
    print("failed", bad, flush=True)
