"""Command line: vocabulary, audit, features, split, training and prediction, and data checks."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import functions as F

from ferrolith.operators import audit as audit_ops
from ferrolith.operators import heads, masks, splits, training
from ferrolith.operators.prediction import HeadRegistry
from ferrolith.operators.vocabulary import Vocabulary, tree_lines
from ferrolith.session import get_session, path_exists
from ferrolith.sinks import load_model, save_model, write_features, write_sections
from ferrolith.sources.registry import Config
from ferrolith.sources.sqlite import read_table


def data_check(paths: list[str]) -> list[tuple[str, bool]]:
    return [(p, Path(p).exists()) for p in paths]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ferrolith")
    commands = parser.add_subparsers(dest="command", required=True)
    check = commands.add_parser("check", help="are all paths there?")
    check.add_argument("paths", nargs="+")
    tree = commands.add_parser("vocabulary", help="print the vocabulary")
    tree.add_argument("--file")
    keys = commands.add_parser("audit", help="join-key audit of a sample database, as CSV sections")
    keys.add_argument("database")
    keys.add_argument("out")
    extract = commands.add_parser("features", help="features of masks (record_id, h, w, px in Parquet)")
    extract.add_argument("masks")
    extract.add_argument("nodes", help="class nodes in order, separated by commas")
    extract.add_argument("out")
    split = commands.add_parser("split", help="group split of a Parquet table")
    split.add_argument("records")
    split.add_argument("group")
    split.add_argument("out")
    split.add_argument("--val", type=float, default=0.2)
    split.add_argument("--test", type=float, default=0.2)
    split.add_argument("--seed", type=int, default=0)
    fit = commands.add_parser("fit-head", help="fit a property head; features (a row a group) and records in Parquet")
    for name in ("features", "records", "scope", "property", "out"):
        fit.add_argument(name)
    router = commands.add_parser("train-router", help="fit the family router on embeddings (embedding, family, group_id in Parquet)")
    classifier = commands.add_parser("train-clf", help="fit the classifier of label sets (embedding, taxonomy_labels, group_id in Parquet)")
    for trained in (router, classifier):
        trained.add_argument("embeddings")
        trained.add_argument("out", help="the model table's folder")
        trained.add_argument("--config")
    guess = commands.add_parser("predict", help="family and property of images (record_id, embedding, features in Parquet)")
    for name in ("images", "models", "heads", "property", "out"):
        guess.add_argument(name)
    args = parser.parse_args(argv)

    if args.command == "check":
        missing = [p for p, there in data_check(args.paths) if not there]
        print("\n".join(f"missing: {p}" for p in missing) or "all there")
        return 1 if missing else 0
    spark = get_session()
    if args.command == "vocabulary":
        lines = tree_lines(Vocabulary.load(args.file).frame(spark)).collect()  # a row for each node
        print("\n".join(r.line for r in lines))
    elif args.command == "audit":
        samples, images = read_table(spark, args.database, "sample"), read_table(spark, args.database, "micrograph")
        write_sections(audit_ops.report_sections(audit_ops.audit_samples(samples, images), images), args.out)
    elif args.command == "features":
        write_features(masks.feature_vector(spark.read.parquet(args.masks), args.nodes.split(",")), args.out)
    elif args.command == "fit-head":
        registry = HeadRegistry()
        registry.register(args.scope, args.property, dict)
        features = spark.read.parquet(args.features) if path_exists(spark, args.features) else None
        return 0 if heads.fit_property_head(registry, args.out, args.scope, args.property, features, spark.read.parquet(args.records)) else 1
    elif args.command in ("train-router", "train-clf"):
        config, rows = Config.load(args.config), spark.read.parquet(args.embeddings)
        if args.command == "train-router":
            model = training.train_router(rows, "embedding", "family", "group_id", config.router_calib_frac, config.router_alpha, config.seed)
        else:
            model = training.train_classifier(rows, "embedding", "taxonomy_labels", "group_id", config.val_frac, config.test_frac, config.seed)
        save_model(spark, args.out, args.command.removeprefix("train-"), model, model["accuracy"])
    elif args.command == "predict":
        router = load_model(spark, args.models, "router")
        if router is None:
            print("no router; train one first")
            return 1
        images = training.route(spark.read.parquet(args.images).drop("family"), router, "embedding")
        found = None
        for family in router["families"]:
            own = heads.predict_property(args.heads, family, args.property, images.filter(F.col("family") == family))
            found = own if found is None else found.unionByName(own)
        out = images.select("record_id", "family", "probabilities").join(found, "record_id", "left")
        reason = F.when(F.col("family").isNull(), "the prediction set is not a single family").otherwise(F.col("reason"))
        out.withColumn("reason", reason).write.mode("overwrite").parquet(args.out)
    else:
        splits.hashed_group_split(spark.read.parquet(args.records), args.group, args.val, args.test, args.seed).write.mode("overwrite").parquet(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
