"""Times the headline queries and prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from claimlake.plans.catalog import QUERIES  # noqa: E402
from claimlake.session import build_session  # noqa: E402

HEADLINE = ("ingest_sources", "inbox_classify", "html_markdown", "allocate_ids", "inherit_sensitivity", "apply_commands",
            "review_schedule", "find_similar", "check_quotes", "quote_audit", "review_marks", "lint_duplicate_claim",
            "lint_quote_not_in_source", "lint_all", "vault_state", "postings", "bm25_idf", "bm25_score", "cosine_score",
            "competition_rank", "bm25_topk", "hybrid_topk", "snapshot_diff", "frontmatter_roundtrip")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                          spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["status_folder"](spark, folder).write.format("noop").mode("overwrite").save()  # start the JVM and read once
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    print(json.dumps({"metric": "headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
