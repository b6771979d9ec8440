"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from foliomill.session import build_session  # noqa: E402
from workload import QUERIES  # noqa: E402

HEADLINE = [
    # text
    "word_count", "mine_title", "mine_doi", "mine_year", "mine_abstract", "chunk_text", "chunk_paragraphs", "build_prompt",
    "choose_page_text", "assemble_document",
    # ingestion
    "corpus_dedup", "known_files", "duplicates_of", "scan_summary", "register_papers",
    # answers
    "decode_responses", "recover_responses", "merge_chunks", "evidence_rows", "summary_markdown",
    # records and corrections
    "canonical_records", "canonical_events", "record_detail", "patched_papers", "delete_cascade", "latest_status",
    # catalogue
    "list_papers_page", "search_papers", "list_papers_total", "list_papers_relations", "status_counts", "author_names",
    # features and export
    "pivot_inputs", "pivot_outputs", "xy_maps", "export_wide", "export_nested", "feature_matrix_x", "coverage_inputs",
    "coverage_all_records",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    # A local run has no shared checkpoint folder; a cluster's session names its own.
    scratch = tempfile.mkdtemp(prefix="bench-")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": f"{scratch}/checkpoints",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    QUERIES["status_counts"](spark, folder).collect()
    for name in names:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        seconds[name] = round(best, 3)
    spark.stop()
    shutil.rmtree(scratch, ignore_errors=True)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, best of two runs each",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
