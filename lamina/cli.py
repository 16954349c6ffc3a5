"""Commands: convert (study files to volumes) and build-graphs (a manifest to graphs)."""

from __future__ import annotations

import argparse
import logging

from . import __doc__ as about


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lamina", description=about)
    p.add_argument("--version", action="version", version="lamina 0.1")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert")
    c.add_argument("--output-dir", required=True)
    c.add_argument("--split", nargs=4, action="append", required=True, metavar=("NAME", "LABELS", "PATHS", "ROOT"))
    c.add_argument("--label-mode", choices=("cancer", "abnormal"), default="cancer")
    c.add_argument("--compression", choices=("zlib", "none"), default="zlib")
    c.add_argument("--overwrite", action="store_true")
    c.add_argument("--no-smart-update", action="store_true", help="skip volumes that are there, however old")
    g = sub.add_parser("build-graphs")
    g.add_argument("--manifest", required=True)
    g.add_argument("--output-dir", required=True)
    g.add_argument("--config")
    g.add_argument("--patients", help="a file with an id on each line, or ids separated by commas")
    g.add_argument("--no-augmentations", action="store_true")
    g.add_argument("--seed", type=int)
    g.add_argument("--no-embeddings", action="store_true")
    g.add_argument("--embedding-weights", metavar="PARQUET", help="vectors of regions (view_key, scale, label, vector), made elsewhere")
    g.add_argument("--num-gpus", type=int, help="taken for its name only: Spark deals the work")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    from pyspark.sql import SparkSession

    from .plans import run
    from .sources import config as C
    from .sources import metadata as M

    spark = SparkSession.builder.appName("lamina").getOrCreate()
    if args.command == "convert":
        counts, failures = run.convert(spark, [tuple(s) for s in args.split], args.output_dir, args.label_mode, args.compression, args.overwrite, not args.no_smart_update)
        M.write_failures(failures, f"{args.output_dir}/failed_views.tsv")
        for r in counts.orderBy("split").toLocalIterator():
            logging.info("%s: %s requested, %s written, %s skipped, %s failed", r.split, r.requested, r.written, r.skipped, r.failed)
        return 0
    config = C.load(args.config)
    if args.no_augmentations:
        for kind in ("augmix", "diffusion", "adversarial"):
            config[kind]["n_per_view"] = 0
    if args.seed is not None:
        config["seed"] = args.seed
    if args.no_embeddings:
        config["embed"]["enabled"] = False
    views, wanted = M.read_csv(spark, args.manifest), M.patients(spark, args.patients) if args.patients else None
    if wanted is not None:
        r = M.matched(views, wanted).first()
        logging.info("patients: %s rows, %s of them of %s requested patients, %s matched", r.rows_before, r.rows_after, r.patients_requested, r.patients_matched)
    vectors = spark.read.parquet(args.embedding_weights) if args.embedding_weights else None
    ledger = run.build(spark, views, args.output_dir, config, wanted, vectors)
    for r in ledger.groupBy("status").count().orderBy("status").toLocalIterator():
        logging.info("%s: %s", r.status, r["count"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
