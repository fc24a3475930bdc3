"""Run every registered query and its SQL on the same folder and compare rows."""

from __future__ import annotations

import math
import sys
import time
import traceback
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
if Path("/opt/oracle").is_dir():
    sys.path.append("/opt/oracle")

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            connection.execute(f"create view {name} as select * from read_parquet('{path}')")
    return connection


def _kind(value) -> str:
    return "number" if isinstance(value, float) else type(value).__name__


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def compare(spark, connection, folder: str, run, sql: str) -> str | None:
    """None if both sides give the same rows, else what differs."""
    df = run(spark, folder)
    names = sorted(df.columns)
    ours = [tuple(r) for r in df.select(*names).collect()]
    cursor = connection.execute(sql)
    theirs_names = [c[0] for c in cursor.description]
    if sorted(theirs_names) != names:
        return f"columns {names} against {sorted(theirs_names)}"
    order = [theirs_names.index(n) for n in names]
    theirs = [tuple(r[i] for i in order) for r in cursor.fetchall()]
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    for i, name in enumerate(names):
        kinds = [{_kind(r[i]) for r in side if r[i] is not None} for side in (ours, theirs)]
        if kinds[0] != kinds[1]:
            return f"type of {name}: {kinds[0]} against {kinds[1]}"
    left, right = (Counter(tuple(_cell(v) for v in r) for r in side) for side in (ours, theirs))
    if left != right:
        return f"{sum((left - right).values())} rows differ, e.g. {list((left - right))[:2]} against {list((right - left))[:2]}"
    return None


def main(folder: str, only: list[str]) -> int:
    import __spark_entry__ as entry
    from tarmac.session import build

    spark = build(master="local[8]", spark__sql__shuffle__partitions=8, spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles, bad = connect(folder), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, connection, folder, run, oracles[name])
            else:
                problem = None if run(spark, folder).count() else "no rows"
        except Exception:
            problem = traceback.format_exc(limit=3)[-1500:]
        bad += problem is not None
        print(f"{name:32s} {'ok' if problem is None else 'BAD ' + problem} {time.time() - start:.1f}s", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
