"""Plan-build vs execution time and job/stage counts per query.

    python tools/profile_queries.py /root/testdata/sf0.1 name [name ...]
"""

from __future__ import annotations

import sys
import time

sys.path.insert(0, ".")


def main(argv):
    sf = argv[1]
    names = argv[2:]
    from acqspark.session import build_session
    from acqspark.plans.mart import Mart
    from acqspark.plans.registry import BUILDERS, ROUNDING
    from acqspark.functions import round_cols
    spark = build_session()
    sc = spark.sparkContext
    for rep in range(2):
        for n in names:
            jobs0 = len(sc.statusTracker().getJobIdsForGroup(None) or [])
            t0 = time.perf_counter()
            m = Mart.from_tables(spark, sf)
            t1 = time.perf_counter()
            df = round_cols(BUILDERS[n](m), *ROUNDING.get(n, ([], [])))
            t2 = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            t3 = time.perf_counter()
            jobs = len(sc.statusTracker().getJobIdsForGroup(None) or []) - jobs0
            if rep:
                print(f"{n:26s} init {t1-t0:5.2f} build {t2-t1:5.2f} exec {t3-t2:5.2f} jobs {jobs}", flush=True)


if __name__ == "__main__":
    main(sys.argv)
