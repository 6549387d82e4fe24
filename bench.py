"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

from compovec.plans import load_catalogue
from compovec.session import local_session

HEADLINE = [
    "segment_sentences", "keyword_labels", "top_sentences", "document_composition",
    "consolidate_votes", "canonical_labels", "multilabel_per_domain", "match_statistics",
    "type_adjusted_coordinates", "covariance", "prototype_distances", "auroc_of_items",
    "score_correlations", "permuted_variance_share", "selection_faithfulness", "stratified_group_folds",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    catalogue = load_catalogue()
    spark.range(1000).selectExpr("sum(id)").collect()      # start the executor before timing
    times: dict[str, float] = {}
    for n in names:
        t = time.time()
        catalogue[n].run(spark, sf).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t, 3)
        print(f"{n}: {times[n]}", file=sys.stderr)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
