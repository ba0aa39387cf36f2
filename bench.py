"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from lorekeep.operators.index import update_index
from lorekeep.plans.queries import QUERIES, corpus, library
from lorekeep.sources.shared import new_table_path
from lorekeep.sources.tables import Tables

HEADLINES = [
    "assemble_documents", "upsert_documents", "changed_documents", "html_to_text", "tokenize", "stem_vocabulary",
    "analyze_content", "rebuild_index", "update_index", "corpus_stats", "search_ranked", "search_totals", "search_page",
    "search_results", "highlight", "authorized_messages", "authorized_commands", "button_pages", "reply_attachments",
    "no_hit_links", "event_replies",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)) if cpus.isdigit() else "16")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = Tables(spark, folder)
    corpus(tables).count()

    took: dict[str, float] = {}

    def timed(name: str, work) -> None:
        start = time.perf_counter()
        work()
        took[name] = round(time.perf_counter() - start, 3)

    # Documents and index of the whole corpus, which the searches then read.
    timed("index_build", lambda: library(tables))
    # One document of a hundred, as a segment of its own.
    built = library(tables).index
    changed = corpus(tables).filter("doc_id % 100 = 0").select("doc_id", "title", "content")
    timed("index_update_1_percent", lambda: update_index(built, changed, new_table_path(spark, "bench-update")))
    for name in HEADLINES:
        timed(name, lambda: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save())
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": folder.rsplit("/sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
