"""Time the headline queries at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from casemill.queries import ALL
from casemill.sources.session import local_session

HEADLINE = (
    "bm25_topk", "bm25_index", "dense_topk", "ranked_rules", "chunks", "title_share_by_rule", "titles_in_texts",
    "citation_rows", "masked_texts", "monthly_cases", "document_labels", "facts_sections", "sentence_split",
    "page_links", "page_texts", "case_labels", "dataset_build", "class_scores", "reliability_bins",
    "bootstrap_macro_f1", "tfidf_weights", "answer_report", "keep_latest", "length_thirds", "quartiles",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        ALL[name][0](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
