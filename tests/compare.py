"""python tests/compare.py [SF_DIR] [QUERY...]: every query beside its DuckDB SQL; prints what differs, and the seconds of each."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tests.conftest import session  # noqa: E402
from tests.rows import same, views  # noqa: E402


def main(args: list[str]) -> int:
    sf = args[0] if args else "/root/testdata/sf0.01"
    spark, con, sql = session(), duckdb.connect(), entry.oracle_sql()
    views(con, sf)
    bad = 0
    for name, f in entry.queries().items():
        if args[1:] and name not in args[1:]:
            continue
        began, said = time.time(), "no SQL"
        try:
            got = f(spark, sf).toPandas()
            took = time.time() - began
            if name in sql:
                said = same(got, con.sql(sql[name]).df()) or "equal"
        except Exception:  # noqa: BLE001 - the list goes on
            took, said = time.time() - began, "FAILED " + traceback.format_exc()[-600:]
            got = ()
        bad += said not in ("equal", "no SQL")
        print(f"{name}: {said}, {len(got)} rows, {took:.1f} s", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
