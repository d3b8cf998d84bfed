"""Staged prediction that records why it abstains, and the registry of fitted heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.functions.text import scope_fallbacks

STAGES = ("family", "features", "property")


def resolve_scopes(requests: DataFrame, scope: str, registry: DataFrame) -> DataFrame:
    """requests with registered_scope and head: of a scope and its parents, the most specific that is registered."""
    each = requests.select(scope).distinct().select(scope, F.posexplode(scope_fallbacks(F.col(scope))).alias("back", "registered_scope"))
    hits = each.join(registry, "registered_scope")
    best = hits.groupBy(scope).agg(F.min_by(F.struct("registered_scope", "head"), "back").alias("b")).select(scope, "b.*")
    return requests.join(best, scope, "left")


def staged(stages: list[tuple[str, Column, Column]]) -> Column:
    """abstentions: the stage's name with its reason for the first stage that fails. stages: (name, succeeds, reason)."""
    empty = F.create_map().cast("map<string,string>")
    out = empty
    for name, succeeds, reason in reversed(stages):
        out = F.when(F.coalesce(succeeds, F.lit(False)), out).otherwise(F.create_map(F.lit(name), reason))
    return out


def predict(images: DataFrame, q_hat: Column, segmenters: DataFrame, heads: DataFrame) -> DataFrame:
    """images (record_id, probabilities, families, features) with family, value and abstentions.

    A family needs a prediction set of one; features need a segmenter of the family; a value needs a fitted head.
    segmenters: family; heads: family, intercept, weights. Later stages are silent once an earlier one abstains.
    """
    from ferrolith.functions.vectors import dot
    from ferrolith.operators.conformal import singleton

    routed = images.withColumn("family", F.get("families", singleton(F.col("probabilities"), q_hat)))
    joined = routed.join(segmenters.select("family", F.lit(True).alias("segmenter")), "family", "left").join(heads, "family", "left")
    reasons = staged([
        ("family", F.col("family").isNotNull(), F.lit("prediction set is not a single family")),
        ("features", F.col("segmenter"), F.concat(F.lit("no segmenter for "), "family")),
        ("property", F.col("weights").isNotNull(), F.concat(F.lit("no fitted head for "), "family")),
    ])
    value = F.when(F.col("segmenter") & F.col("weights").isNotNull(), dot(F.col("features"), F.col("weights")) + F.col("intercept"))
    return joined.select("record_id", "family", value.alias("value"), reasons.alias("abstentions"))


class HeadRegistry:
    """(scope, property) -> class of a head; more specific scopes win over their parents."""

    def __init__(self) -> None:
        self._heads: dict[tuple[str, str], type] = {}

    def register(self, scope: str, property_name: str, head: type) -> None:
        if not isinstance(head, type):
            raise TypeError("a head must be a class")
        self._heads[scope, property_name] = head

    def registered(self) -> list[tuple[str, str]]:
        return sorted(self._heads)

    def find(self, scope: str, property_name: str) -> type | None:
        parts = scope.split("/")
        return next((self._heads[k] for n in range(len(parts), 0, -1) if (k := ("/".join(parts[:n]), property_name)) in self._heads), None)

    def for_family(self, family: str) -> list[tuple[str, str]]:
        return [k for k in self.registered() if k[0].split("/")[0] == family]
