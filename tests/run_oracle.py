"""Command line: compare all or the named queries at one scale (default sf0.01)."""

import os
import sys
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from tablewright.session import build_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

if __name__ == "__main__":
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = [q for q in queries if not sys.argv[1:] or any(q.startswith(a) for a in sys.argv[1:])]
    failed = 0
    for name in wanted:
        try:
            problem, seconds, n = compare(spark, con, sf_dir, queries[name], oracles.get(name))
        except Exception as error:  # noqa: BLE001
            problem, seconds, n = f"{type(error).__name__}: {str(error)[:600]}", 0.0, -1
            if len(wanted) < 4:
                traceback.print_exc()
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {seconds:6.2f}s {n:7d} "
              f"{'' if name in oracles else '[rows only] '}{problem[:700]}", flush=True)
        spark.catalog.clearCache()
    print(f"{len(wanted) - failed}/{len(wanted)} ok")
