"""Model version tables: lineage, comparison, listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtline.session import ensure_checkpoint_dir

# Direction of each metric, tie width, values of missing metrics.
HIGHER_BETTER = ["accuracy", "roi", "sharpe_ratio", "win_rate"]
LOWER_BETTER = ["brier_score", "log_loss", "margin_mae", "total_mae", "loss", "max_drawdown"]
TIE = 0.001


def lineage(
    versions: DataFrame, roots: DataFrame, version: str = "version", parent: str = "parent_version"
) -> DataFrame:
    """(version, ancestor, steps) for the versions in ``roots``, each its own ancestor at 0.

    Paths are doubled: round k joins the paths found so far with the table of ancestors at
    distance 2^k, and that table with itself, so n generations take about log2 n rounds. An
    ancestor counts at its smallest distance, so a cycle ends. Asked versions that do not exist
    have no rows.
    """
    ensure_checkpoint_dir(versions.sparkSession)
    asked = roots.select(F.col(version).alias("v")).distinct()
    known = versions.select(F.col(version).alias("v")).join(asked, "v", "left_semi").distinct()
    jump = (
        versions.filter(F.col(parent).isNotNull()).select(F.col(version).alias("at"), F.col(parent).alias("far"))
        .distinct().checkpoint()
    )
    paths = known.select("v", F.col("v").alias("a"), F.lit(0).alias("steps")).checkpoint()
    found, distance = paths.count(), 1
    while True:
        further = paths.join(jump, F.col("a") == F.col("at")).select("v", F.col("far").alias("a"), (F.col("steps") + distance).alias("steps"))
        paths = paths.union(further).groupBy("v", "a").agg(F.min("steps").alias("steps")).checkpoint()
        if (now := paths.count()) == found:
            break
        found, distance = now, distance * 2
        onward = jump.select(F.col("at").alias("far"), F.col("far").alias("beyond"))
        jump = jump.join(onward, "far").select("at", F.col("beyond").alias("far")).distinct().checkpoint()
    return paths.select(F.col("v").alias("version"), F.col("a").alias("ancestor"), "steps")


def metric_changes(pairs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Improvement from a to b per metric of either; a missing value counts 0.

    ``pairs`` has version_a and version_b, ``metrics`` version, metric and value.
    """
    sides = []
    for s in ("a", "b"):
        sides.append(
            pairs.join(
                metrics.select(F.col("version").alias(f"version_{s}"), "metric", F.col("value").alias(f"value_{s}")),
                f"version_{s}",
            ).select("version_a", "version_b", "metric", f"value_{s}")
        )
    both = sides[0].join(sides[1], ["version_a", "version_b", "metric"], "full")
    change = F.coalesce("value_b", F.lit(0.0)) - F.coalesce("value_a", F.lit(0.0))
    return both.select(
        "version_a", "version_b", "metric",
        F.when(F.col("metric").isin(LOWER_BETTER), -change).otherwise(change).alias("improvement"),
    )


def winners(pairs: DataFrame, metrics: DataFrame) -> DataFrame:
    """The better version of each pair, and by loss alone.

    Accuracy decides, then Brier score, then margin error, each beyond the tie
    width; a full tie goes to b.
    """
    names = {"accuracy": 0.0, "brier_score": 1.0, "margin_mae": float("inf"), "loss": float("inf")}
    wide = metrics.groupBy("version").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in names]
    )
    joined = pairs
    for s in ("a", "b"):
        joined = joined.join(
            wide.select(F.col("version").alias(f"version_{s}"), *[F.col(m).alias(f"{m}_{s}") for m in names]),
            f"version_{s}", "left",
        )
    val = lambda m, s: F.coalesce(f"{m}_{s}", F.lit(names[m]))

    def apart(m: str) -> Column:
        # two infinities are no difference
        return F.coalesce(
            F.when(val(m, "a") == val(m, "b"), False).otherwise(F.abs(val(m, "a") - val(m, "b")) > TIE),
            F.lit(False),
        )

    a, b = F.col("version_a"), F.col("version_b")
    pick = (
        F.when(apart("accuracy"), F.when(val("accuracy", "b") > val("accuracy", "a"), b).otherwise(a))
        .when(apart("brier_score"), F.when(val("brier_score", "b") < val("brier_score", "a"), b).otherwise(a))
        .when(apart("margin_mae"), F.when(val("margin_mae", "b") < val("margin_mae", "a"), b).otherwise(a))
        .otherwise(b)
    )
    by_loss = F.when(val("loss", "a") < val("loss", "b"), a).otherwise(b)
    return joined.select("version_a", "version_b", pick.alias("winner"), by_loss.alias("lower_loss"))


def newest_first(versions: DataFrame) -> DataFrame:
    created = F.coalesce("created_at", F.lit("1970-01-01").cast("date"))
    return versions.orderBy(created.desc(), F.col("version").desc())
