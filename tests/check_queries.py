"""Run registered queries against their SQL: ``python -m tests.check_queries [sf] [name part ...]``."""

from __future__ import annotations

import sys
import time
import traceback

from tablelens.plans import load_all
from tablelens.session import local_session
from tests.compare import connect, differences


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    queries, oracle = load_all()
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = []
    for name, fn in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracle:
                note = differences(df, con, oracle[name])
                n = ""
            else:
                note, n = None, f" rows={len(df.collect())}"
        except Exception as err:  # noqa: BLE001 - a report, all failures are listed
            note, n = f"{type(err).__name__}: {str(err)[:700]}", ""
            if "-v" in sys.argv:
                traceback.print_exc()
        kind = "sql " if name in oracle else "rows"
        print(f"{'FAIL' if note else 'ok  '} {kind} {time.time() - start:6.2f}s {name}{n} {note or ''}", flush=True)
        if note:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
