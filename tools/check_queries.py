"""Run registered queries and their SQL side by side and report differences.

usage: python tools/check_queries.py [sf] [name-prefix ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from corpusflow.queries import load  # noqa: E402
from corpusflow.queries.compare import canonical, connect, oracle_rows  # noqa: E402
from corpusflow.session import local_session  # noqa: E402


KINDS = {"bigint": "int", "int": "int", "double": "float", "string": "text", "boolean": "flag",
         "BIGINT": "int", "INTEGER": "int", "DOUBLE": "float", "VARCHAR": "text", "BOOLEAN": "flag"}


def kinds(columns) -> dict[str, str]:
    """Column kinds that both engines have; anything else under its own name."""
    return {name: KINDS.get(str(kind), str(kind)) for name, kind in columns}


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    wanted = sys.argv[2:]
    folder = f"/root/testdata/{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = load()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            got = canonical(df.columns, df.collect())
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {(str(exc).strip().splitlines() or [repr(exc)])[0][:600]}", flush=True)
            continue
        took = time.time() - start
        if name not in oracles:
            print(f"rows {name}: {len(got[1])} rows {took:.1f}s", flush=True)
            continue
        start = time.time()
        try:
            want = oracle_rows(con, oracles[name])
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"SQL  {name}: {str(exc)[:900]}", flush=True)
            continue
        mine, theirs = kinds(df.dtypes), kinds((r[0], r[1]) for r in con.execute(f"DESCRIBE {oracles[name]}").fetchall())
        if mine != theirs:
            print(f"TYPE {name}: {sorted(set(mine.items()) ^ set(theirs.items()))}", flush=True)
        if got == want:
            print(f"ok   {name}: {len(got[1])} rows {took:.1f}s (sql {time.time() - start:.1f}s)", flush=True)
            continue
        bad += 1
        print(f"DIFF {name}: columns {got[0]} / {want[0]}; rows {len(got[1])} / {len(want[1])}", flush=True)
        for side, mine, other in (("spark", got[1], set(want[1])), ("sql", want[1], set(got[1]))):
            print(f"   {side}: {[r for r in mine if r not in other][:3]}"[:700], flush=True)
    print("bad:", bad)
    return int(bad > 0)


if __name__ == "__main__":
    raise SystemExit(main())
