"""Commands: python -m canopyspark.plans.cli {extract,process,transitions,aggregate} --config FILE."""

from __future__ import annotations

import argparse
import logging
from pathlib import Path

from ..session import session
from . import stages
from .config import LOADERS


def _log_to(folder: Path, name: str) -> None:
    folder.mkdir(parents=True, exist_ok=True)
    handler = logging.FileHandler(folder / f"{name}.log")
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    logging.getLogger().addHandler(handler)
    logging.getLogger().setLevel(logging.INFO)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("stage", choices=sorted(LOADERS))
    parser.add_argument("--config", required=True, type=Path)
    parser.add_argument("--mode", choices=["normal", "check", "plot"], default="normal", help="extract: all of a site-year, only regions without a file, or a picture of each site-year's regions")
    parser.add_argument("--plot-dir", type=Path, help="extract: where pictures of regions go")
    parser.add_argument("--force", action="store_true", help="process, transitions: write units that are done again")
    parser.add_argument("--exclude-csv", type=Path, help="aggregate: uid, year pairs to leave out")
    parser.add_argument("--verbose", action="store_true", help="aggregate: log a line for each series")
    parser.add_argument("--master", help="Spark master; by default what spark-submit says")
    given = parser.parse_args(args)
    cfg = LOADERS[given.stage](given.config)
    folder = cfg.output_path.parent if given.stage == "aggregate" else cfg.output_root
    _log_to(folder, given.stage)
    spark = session(master=given.master)
    log = logging.getLogger(__name__)
    if given.stage == "extract":
        cfg.plot_dir = given.plot_dir or cfg.plot_dir
        if given.mode == "plot":
            log.info("pictures: %d", stages.plot_overlays(spark, cfg))
        else:
            log.info("extracted: %s", stages.run_extraction(spark, cfg, given.mode))
    elif given.stage == "aggregate":
        if given.exclude_csv is not None:
            cfg.exclude_csv_path = given.exclude_csv
        log.info("%s", stages.run_aggregation(spark, cfg, given.verbose)[1])
    else:
        run = stages.run_processing if given.stage == "process" else stages.run_modelling
        for row in run(spark, cfg, given.force).groupBy("status").count().collect():
            log.info("%s: %d", row["status"], row["count"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
