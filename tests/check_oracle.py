"""Run registered queries against their SQL twins: python tests/check_oracle.py SF_DIR [name ...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(cell(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = Counter(tuple(cell(r[i]) for i in at) for r in cur.fetchall())
    if got == want:
        return None
    extra, missing = got - want, want - got
    return f"{sum(got.values())} vs {sum(want.values())} rows; only spark {list(extra.items())[:2]}; only sql {list(missing.items())[:2]}"


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main(sf_dir, *names):
    import __spark_entry__ as entry
    from jobsieve.session import local_session

    spark = local_session(cores="8")
    con = connect(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or qs:
        t = time.time()
        try:
            if name in sqls:
                why = compare(spark, con, qs[name], sqls[name], sf_dir)
            else:
                why = None if (n := qs[name](spark, sf_dir).count()) else "no rows"
                print(f"     {name}: rows only, {n}")
        except Exception as e:  # report and go on with the next query
            why = f"{type(e).__name__}: {str(e)[:600]}"
        bad += why is not None
        print(f"{'ok  ' if why is None else 'FAIL'} {name} {time.time() - t:.1f}s {why or ''}", flush=True)
    print(f"{bad} failed of {len(names or qs)}")


if __name__ == "__main__":
    main(*sys.argv[1:])
