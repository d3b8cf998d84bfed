"""Adapters by name: each makes canonical records from its configuration."""

from __future__ import annotations

import contextlib
from collections.abc import Callable
from functools import reduce
from pathlib import Path
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrolith.operators import validation as V
from ferrolith.operators.vocabulary import CONDITION_AXIS, DEFAULT_AXIS, GRADE_AXIS, Vocabulary

_ADAPTERS: dict[str, tuple[str, Callable[..., DataFrame]]] = {}


# Where things lie below the data and the checkpoint folder, by the names that sources of such data use.
PLACES = {
    "sqlite": ("data_dir", "microstructures.sqlite"), "micrographs": ("data_dir", "micrographs"), "segmentation": ("data_dir", "segmentation"), "hardness": ("data_dir", "hardness_labels.csv"),
    "property_lookup": ("data_dir", "property_lookup.csv"), "literature_manifest": ("data_dir", "literature_steel/manifest.csv"), "features": ("data_dir", "features.csv"),
    "backbone": ("checkpoint_dir", "backbone.pt"), "segmenter": ("checkpoint_dir", "segmenter.pt"), "classifier": ("checkpoint_dir", "classifier.pt"), "router": ("checkpoint_dir", "router.pt"), "heads": ("checkpoint_dir", "heads"),
}
# The settings that commands use, with their defaults. A setting's kind is its default's.
SETTINGS = {
    "records": {"adapters": (), "min_confidence": "medium", "options": {}},
    "train-router": {"router_alpha": 0.1, "router_calib_frac": 0.25, "seed": 42},
    "train-clf": {"val_frac": 0.15, "test_frac": 0.15, "seed": 42},
}


class Config:
    """Settings by command, and the folders of data and of checkpoints; all others keep their defaults."""

    def __init__(self, **given):
        self.data_dir, self.checkpoint_dir = Path(given.pop("data_dir", "data")), Path(given.pop("checkpoint_dir", "checkpoints"))
        known = {name: default for settings in SETTINGS.values() for name, default in settings.items()}
        if unknown := sorted(given.keys() - known.keys()):
            raise ValueError(f"unknown settings {unknown}; there are {sorted(['data_dir', 'checkpoint_dir', *known])}")
        for name, default in known.items():
            setattr(self, name, type(default)(given.get(name, default)))
        if self.min_confidence not in V.CONFIDENCE_LEVELS:
            raise ValueError(f"min_confidence must be one of {V.CONFIDENCE_LEVELS}, not {self.min_confidence!r}")

    def place(self, name: str) -> Path:
        folder, rest = PLACES[name]
        return getattr(self, folder) / rest

    @staticmethod
    def load(path: str | Path | None = None) -> "Config":
        """The defaults, with the settings of a TOML file over them."""
        with contextlib.ExitStack() as stack:
            return Config(**(tomllib.load(stack.enter_context(open(path, "rb"))) if path else {}))


def register_adapter(name: str, family: str):
    """Decorator for (spark, config, adapter_ord) -> records."""
    if not name or not family:
        raise ValueError("an adapter needs a name and a family")

    def add(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _ADAPTERS[name] = (family, make)
        return make

    return add


def available_adapters() -> list[str]:
    return sorted(_ADAPTERS)


def get_adapter(name: str) -> tuple[str, Callable[..., DataFrame]]:
    if name not in _ADAPTERS:
        raise KeyError(f"unknown adapter {name!r}; there are {available_adapters()}")
    return _ADAPTERS[name]


def all_records(spark: SparkSession, config: Config) -> DataFrame:
    """Records of all configured adapters, in their order."""
    frames = [get_adapter(name)[1](spark, config, i) for i, name in enumerate(config.adapters)]
    if not frames:
        raise ValueError("no adapter is configured")
    return reduce(lambda a, b: a.unionByName(b), frames)


def record_violations(spark: SparkSession, records: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """record_id, node, problem of ids that are unknown or on another axis, and of odd property sources."""
    nodes = vocabulary.frame(spark).select(F.col("id").alias("node"), F.col("axis").alias("found_axis"))
    used = {"taxonomy_labels": DEFAULT_AXIS, "mask_class_nodes": DEFAULT_AXIS, "alloy_grade": GRADE_AXIS, "condition": CONDITION_AXIS}
    kinds = dict(records.dtypes)
    # One stream of (column, axis, node) for each record; the property sources' problem rides along as a row without a node.
    def uses(column: str, axis: str) -> Column:
        ids = F.col(column) if kinds[column].startswith("array") else F.array(F.col(column))
        return F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda n: F.struct(F.lit(column).alias("column"), F.lit(axis).alias("axis"), n.alias("node")))

    sources = F.when(V.odd_sources(), F.array(F.struct(F.lit("property_sources").alias("column"), F.lit(None).cast("string").alias("axis"), F.lit(None).cast("string").alias("node"))))
    each = records.select("record_id", F.explode(F.concat(*[uses(c, a) for c, a in used.items()], F.coalesce(sources, F.array().cast("array<struct<column: string, axis: string, node: string>>")))).alias("u")).select("record_id", "u.*")
    met = each.filter("node IS NOT NULL OR axis IS NULL").join(F.broadcast(nodes), "node", "left")  # the vocabulary, a fixed tree
    problem = F.when(F.col("axis").isNull(), F.col("column")).when(F.col("found_axis").isNull(), F.concat("column", F.lit(": unknown"))).when(F.col("found_axis") != F.col("axis"), F.concat(F.col("column"), F.lit(": not on "), F.col("axis")))
    return met.withColumn("problem", problem).filter("problem IS NOT NULL").select("record_id", "node", "problem")
