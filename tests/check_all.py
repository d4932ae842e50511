"""Run every registered query against its oracle (default sf0.01) and print a
summary.  ``python tests/check_all.py [sf_dir] [name ...]``

``ORDERLENS_CHECK_TZ=America/Los_Angeles`` runs the Spark side in that session
time zone (results must not depend on it).
"""

import json
import os
import sys
import time

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from oracle_util import compare, duck  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from orderlens.session import local_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
only = set(sys.argv[2:])
spark = local_session()
if os.environ.get("ORDERLENS_CHECK_TZ"):
    spark.conf.set("spark.sql.session.timeZone", os.environ["ORDERLENS_CHECK_TZ"])
con = duck(sf)
qs, orc = E.queries(), E.oracle_sql()
bad = 0
for name, fn in qs.items():
    if only and name not in only:
        continue
    t0 = time.time()
    try:
        df = fn(spark, sf)
        if name in orc:
            r = compare(df, con, orc[name])
        else:
            r = {"rows": (df.count(), None), "ok": True, "rows_only": True}
    except Exception as e:  # noqa: BLE001
        r = {"ok": False, "error": repr(e)[:400]}
    r["sec"] = round(time.time() - t0, 2)
    bad += not r["ok"]
    print(name, json.dumps(r, default=str), flush=True)
print("FAILED" if bad else "ALL OK", bad, "of", len(qs))
sys.exit(1 if bad else 0)
