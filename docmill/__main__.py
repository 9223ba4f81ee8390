"""``python -m docmill FOLDER STORE [--reset]``: ingest a folder of PDFs."""
import argparse
import logging

from pyspark.sql import SparkSession

from docmill.plans.pipeline import ingest_directory


def main(argv=None) -> None:
    parser = argparse.ArgumentParser(prog="docmill")
    parser.add_argument("folder")
    parser.add_argument("store")
    parser.add_argument("--reset", action="store_true", help="drop the store first")
    parser.add_argument("--log", help="also append the log to this file")
    args = parser.parse_args(argv)
    log = logging.getLogger("docmill")
    log.setLevel(logging.INFO)
    log.addHandler(logging.StreamHandler())
    if args.log:
        log.addHandler(logging.FileHandler(args.log))
    for handler in log.handlers:
        handler.setFormatter(logging.Formatter("{asctime} {levelname} {message}", style="{"))
    spark = SparkSession.builder.appName("docmill").getOrCreate()
    ingest_directory(spark, args.folder, args.store, args.reset).orderBy("file").show(50, False)


if __name__ == "__main__":
    main()
