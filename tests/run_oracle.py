"""python tests/run_oracle.py SF_DIR [name ...]: compare catalog queries with SQL."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from moodmill.catalog import all_queries  # noqa: E402
from moodmill.session import local_session  # noqa: E402
from tests.oracle import connect, difference  # noqa: E402


def main() -> int:
    sf_dir, wanted = sys.argv[1], set(sys.argv[2:])
    spark, con = local_session(8), connect(sf_dir)
    bad = 0
    for name, query in all_queries().items():
        if wanted and name not in wanted and query.fn.__module__.rsplit(".", 1)[-1] not in wanted:
            continue
        start = time.time()
        try:
            found = difference(spark, con, query, sf_dir)
        except Exception as e:  # noqa: BLE001
            found = "error " + "".join(traceback.format_exception_only(e))[:1500]
        bad += found is not None
        note = "" if query.sql else " (no sql)"
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.1f}s{note} {(found or '')[:1500]}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
