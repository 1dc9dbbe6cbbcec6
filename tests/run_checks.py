"""Run every registered query against its SQL and print what differs and how long each took.

    python tests/run_checks.py [sf] [part of a query name ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.oracle import connect, differences  # noqa: E402
from wrenchlake.querybook.book import all_queries  # noqa: E402
from wrenchlake.session import local_session  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("checks")
    con = connect(sf_dir)
    failed = 0
    for q in all_queries():
        if wanted and not any(w in q.name for w in wanted):
            continue
        start = time.time()
        try:
            df = q.run(spark, sf_dir)
            if q.sql is None:
                note = f"rows only: {df.count()}"
            else:
                note = differences(df, con, q.sql)
                failed += note is not None
        except Exception as error:  # noqa: BLE001
            failed += 1
            note = "ERROR " + str(error)[:1500]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        print(f"{'ok  ' if note is None else 'note'} {q.name} {time.time() - start:.2f}s {note or ''}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
