"""The job from the shell: `spark-submit wattloom/plans/__main__.py LAYOUT.json STEP [options]`, or `python -m wattloom.plans`."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from wattloom.plans import run
from wattloom.session import configure


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("layout", help="JSON with the keys of Layout")
    parser.add_argument("step", choices=["silver", "gold", "train", "submit"])
    parser.add_argument("--train", help="raw training readings (silver)")
    parser.add_argument("--labels", help="raw labels (silver)")
    parser.add_argument("--test", help="raw test readings (silver)")
    parser.add_argument("--sheet", action="append", default=[], help="fact sheet in CSV, may be repeated (silver)")
    parser.add_argument("--add", action="store_true", help="use the additional buildings (gold)")
    parser.add_argument("--holidays", help="parquet of (state, day) with state codes (gold)")
    options = parser.parse_args()

    spark = configure(SparkSession.builder.getOrCreate())
    layout = run.layout_from(options.layout)
    if options.step == "silver":
        run.build_silver(spark, layout, options.train, options.labels, options.test, options.sheet)
    elif options.step == "gold":
        holidays = spark.read.parquet(options.holidays) if options.holidays else None
        run.build_gold(spark, layout, options.add, holidays)
        run.build_test_gold(spark, layout, holidays)
    elif options.step == "train":
        run.train(spark, layout)
    else:
        run.submit(spark, layout)


if __name__ == "__main__":
    main()
