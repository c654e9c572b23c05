"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8); names on the
command line select other queries ("all" for every registered one).
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "species_phenotype", "group_quantiles", "site_class", "mad_outlier_by_species", "best_per_group", "majority_label", "ntile_calibration",
    "rank_within", "site_diversity", "consensus_state", "ungapped_index", "major_minor", "supermatrix", "explode_sites", "kmer_counts", "kmer_presence",
    "codon_usage", "fourfold_gc", "kidera_vector", "interval_join_point_in_range", "grid_lookup_join", "nearest_site_1d", "spearman_test", "wilcoxon_rank_sum",
    "fisher_exact_2x2", "p_adjust", "site_anova_scan", "site_scan_with_covariates", "kmer_label_scan", "corrwith", "pca_fit", "rv_coefficient", "cosine_matrix",
    "morans_i", "extract_substitutions", "clade_mean", "tree_index", "surface_proxy", "cross_candidates", "stream_occurrence_filter",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from cladeloom.plans import QUERIES
    from cladeloom.session import get_spark
    spark = get_spark("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.cladeloom.spread": str(4 * int(cpus)), "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for n in names:
        t = time.time()
        try:
            QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[n] = round(time.time() - t, 3)
        except Exception as e:  # noqa: BLE001
            times[n] = None
            print(f"{n} failed: {str(e)[:300]}", file=sys.stderr)
        if os.environ.get("BENCH_VERBOSE"):
            print(f"{n} {times[n]}", file=sys.stderr, flush=True)
    total = round(sum(x for x in times.values() if x is not None), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))


if __name__ == "__main__":
    main()
