"""Command line: python -m lattica preprocess | inspect | sample | draft."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lattica.functions.embedders import AT_ONCE, BATCH, Hashing, Http, Zero, request_totals
from lattica.operators.profile import draft
from lattica.operators.sampling import SamplerConfig
from lattica.plans.inspect import batch_report, report
from lattica.plans.preprocess import preprocess
from lattica.sources.annotation import Annotation
from lattica.sources.database import Database
from lattica.streaming.batches import Sampler


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lattica")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("preprocess", help="encode a folder of Parquet tables")
    a.add_argument("--annotation", required=True)
    a.add_argument("--data-dir", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--embedder", choices=("hashing", "zero", "http"), default="hashing")
    a.add_argument("--skip-embeddings", action="store_true", help="the same as --embedder zero")
    a.add_argument("--url", help="where the http embedder posts to")
    a.add_argument("--batch-size", type=int, default=BATCH, help="strings of one request")
    a.add_argument("--max-concurrent", type=int, default=AT_ONCE, help="requests that one task has under way")
    a = sub.add_parser("inspect", help="report on an encoded database")
    a.add_argument("--db-dir", required=True)
    for what in ("rows", "nodes", "seeds"):
        a.add_argument(f"--sample-{what}", type=int, default=5)
    a = sub.add_parser("sample", help="show one batch")
    a.add_argument("--db-dir", required=True)
    a.add_argument("--batch-size", type=int, default=4)
    a.add_argument("--sequence-length", type=int, default=256)
    a.add_argument("--bfs-child-width", type=int, default=16)
    a = sub.add_parser("draft", help="draft an annotation by rules")
    a.add_argument("data_dir")
    a.add_argument("--name", default="database")
    a.add_argument("--out", required=True)
    a.add_argument("--force", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    o = parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if o.command == "preprocess":
        embedder = Zero() if o.skip_embeddings else {"hashing": Hashing, "zero": Zero, "http": lambda: Http(o.url, batch=o.batch_size, at_once=o.max_concurrent)}[o.embedder]()
        totals = request_totals(spark)
        preprocess(spark, o.data_dir, Annotation.load(o.annotation), o.out, embedder, totals)
        if totals.value[0]:
            names = ("serialize", "http", "deserialize", "convert")
            print(f"{totals.value[0]} requests;", ", ".join(f"{n} {t / 1e6:.3f} s" for n, t in zip(names, totals.value[1:], strict=True)))
    elif o.command == "inspect":
        print(report(Database.load(spark, o.db_dir), o.sample_rows, o.sample_nodes, o.sample_seeds))
    elif o.command == "sample":
        config = SamplerConfig(batch_size=o.batch_size, sequence_length=o.sequence_length, bfs_child_width=o.bfs_child_width, batches_per_job=1)
        got = Sampler(Database.load(spark, o.db_dir), config).batches("train", 0, 1)
        print(batch_report(got[0]) if got else "no seeds to train on")
    else:
        draft(spark, o.data_dir, o.name).save(o.out, o.force)


if __name__ == "__main__":
    main()
