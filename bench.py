"""Headline queries: wall seconds each, after one warm-up, written to the noop sink.  Prints one JSON line."""
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from auditframe.session import local_session  # noqa: E402
import suite  # noqa: E402

HEADLINE = ["clean_text", "lines_to_blocks", "split_policy", "split_template", "anchor_clauses", "reconstruct_sections", "extract_key_facts", "classify_contract", "contract_schema",
            "lexical_topk", "vector_topk", "template_match", "policy_pool_topk", "best_clause_match", "evidence_segments", "run_rules", "eval_decision_table", "issues_by_severity",
            "version_context", "list_overlap", "task_state"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "auditframe-bench")
    spark.sparkContext.setLogLevel("ERROR")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    budget = float(os.environ.get("BENCH_BUDGET", "1500"))
    times, start = {}, time.time()
    spark.range(1000).selectExpr("sum(id)").collect()
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        if time.time() - start > budget:
            break
        seen = []
        for _ in range(runs):
            t = time.time()
            suite.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seen.append(time.time() - t)
        times[name] = round(statistics.median(seen), 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
