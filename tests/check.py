"""Run registered queries against DuckDB: ``python tests/check.py [sf_dir] [name ...]``."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import connect, difference  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracle:
                verdict = difference(con, df, oracle[name])
            else:
                verdict = None
                print(f"     {name}: {df.count()} rows, no SQL")
        except Exception as error:  # noqa: BLE001
            verdict = "ERROR " + str(error)[:1500]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += verdict is not None
        print(f"{'ok  ' if verdict is None else 'FAIL'} {name} {time.time() - start:.1f}s {verdict or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


main()
