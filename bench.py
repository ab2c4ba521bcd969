"""Times the headline queries and prints one JSON line.

Each query runs twice into a sink that discards rows; the second, warm run counts.
"""

from __future__ import annotations

import json
import os
import time

from plaudit.session import build_session

HEADLINE = [
    "reviewer_weights", "monthly_weights", "enrich_reviews", "restaurant_vectors", "lexicon_scores",
    "top_words", "aspect_pairs", "opinion_sentiment", "polarity_hits", "aspect_assign",
    "language_assign", "ar_fit", "acf", "weighted_scores", "zscore_vectors",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split()
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    from plaudit.plans.catalog import QUERIES

    times: dict[str, float] = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
