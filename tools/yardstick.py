"""Time the SQL of the headline queries in DuckDB: an independent yardstick for bench.py.

usage: python tools/yardstick.py [folder] [threads]
"""

import json
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from bench import HEADLINE  # noqa: E402
from check_oracles import TABLES  # noqa: E402

from sentispark.plans import catalog  # noqa: E402


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    db = duckdb.connect(config={"threads": int(sys.argv[2]) if len(sys.argv) > 2 else 8})
    db.execute("SET TimeZone='UTC'")
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            begin = time.time()
            db.execute(f"CREATE OR REPLACE TEMP TABLE sink AS {catalog.ORACLES[name]}")
            seconds[name] = round(time.time() - begin, 3)
    print(json.dumps({"metric": "headline SQL in DuckDB, warm", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds}))


if __name__ == "__main__":
    main()
