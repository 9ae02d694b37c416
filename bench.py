"""Time the headline queries: prints one JSON line. Reads BENCH_SF_DIR and BENCH_CPUS."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.queries import QUERIES  # noqa: E402
from hushframe.session import local_session  # noqa: E402

HEADLINE = (
    "profile_numeric", "profile_missing", "profile_top_values", "profile_duplicates", "profile_duplicates_wide",
    "text_profile", "keywords_by_doc", "keywords_by_lang", "pii_cells_strict", "pii_cells_orders",
    "pii_text_documents", "pii_text_pages", "pii_text_conversations", "pii_text_notes_strict", "pii_report_totals",
    "token_dictionary_cells", "anonymized_people", "anonymized_orders", "anonymized_documents", "replaced_counts_text",
    "context_stats", "context_text", "payload_size_guard", "sample_strict", "release_decisions",
    "conversation_newest_first", "release_payload_table",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "hushframe-bench")
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # Every row and column is computed, nothing is collected.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
