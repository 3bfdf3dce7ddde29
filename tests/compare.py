"""Compare a query with its SQL in DuckDB: names, types of values, and all rows.

`python tests/compare.py [scale] [name ...]` checks from the command line.
"""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(names, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(repr(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> str | None:
    mine, theirs = canonical(df.columns, [tuple(r) for r in df.collect()]), None
    cur = con.execute(sql)
    theirs = canonical([d[0] for d in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if mine[1] != theirs[1]:
        extra, lost = list((mine[1] - theirs[1]).items()), list((theirs[1] - mine[1]).items())
        return (f"{sum(mine[1].values())} rows against {sum(theirs[1].values())}; "
                f"{len(extra)} only here {extra[:4]}; {len(lost)} only in SQL {lost[:4]}")
    return None


def main() -> int:
    from cohort_engine.queries import ORACLES, QUERIES
    from cohort_engine.session import build_session
    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    folder = f"/root/testdata/sf{scale}"
    spark = build_session(master="local[8]", shuffle_partitions=8, **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(folder), 0
    for name in wanted:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            problem = differences(df, con, ORACLES[name]) if name in ORACLES else f"no SQL, {df.count()} rows"
        except Exception as error:  # noqa: BLE001 - reported and counted
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None and not problem.startswith("no SQL")
        print(f"{name:32s} {time.time() - start:6.2f}s  {problem or 'ok'}", flush=True)
    print(f"{len(wanted)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
