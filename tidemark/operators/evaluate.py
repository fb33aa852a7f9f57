"""Evaluation: recall, quality and latency summaries, frontiers, tag layouts, traces."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import rounded

#: two-sided 95 % points of Student's t by degrees of freedom; beyond the list, the normal one
T95 = [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042]


def recall_per_query(found: DataFrame, truth: DataFrame, k: int | None = None) -> DataFrame:
    """qid and recall of found(qid, id) against truth(qid, id): over k, or over the truth's size."""
    hit = truth.join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    over = F.lit(k) if k else F.count(F.lit(1))
    return hit.groupBy("qid").agg(rounded(F.coalesce(F.sum("hit"), F.lit(0)) / over).alias("recall"))


def quality(recalls: DataFrame) -> DataFrame:
    p = lambda q: rounded(F.percentile("recall", F.lit(q)))
    return recalls.agg(rounded(F.avg("recall")).alias("mean"), p(0.05).alias("p05"), p(0.5).alias("p50"), p(0.95).alias("p95"), rounded(F.avg((F.col("recall") >= 1).cast("double"))).alias("perfect"))


def latency(samples: DataFrame, column: str, group: Sequence[str] = ()) -> DataFrame:
    """Count, mean and interpolated percentiles."""
    p = lambda q: rounded(F.percentile(column, F.lit(q)))
    return samples.groupBy(*group).agg(F.count(column).alias("n"), rounded(F.avg(column)).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


def confidence(samples: DataFrame, column: str, group: Sequence[str] = ()) -> DataFrame:
    """n, mean and the half width of the 95 % interval (null for one sample)."""
    table = F.array(*(F.lit(t) for t in T95))
    stats = samples.groupBy(*group).agg(F.count(column).alias("n"), F.avg(column).alias("m"), F.stddev_samp(column).alias("s"))
    t = F.when(F.col("n") - 1 <= len(T95), F.try_element_at(table, F.greatest(F.col("n") - 1, F.lit(1)).cast("int"))).otherwise(1.96)
    return stats.select(*group, "n", rounded(F.col("m")).alias("mean"), rounded(F.when(F.col("n") > 1, t * F.col("s") / F.sqrt("n"))).alias("half_width"))


def frontier(runs: DataFrame, targets: Sequence[float]) -> DataFrame:
    """target and the best qps of runs(recall, qps) at or above it (null where none reaches it)."""
    t = runs.sparkSession.createDataFrame([(float(x),) for x in targets], "target double")
    best = [F.max(F.when(F.col("recall") >= x, F.col("qps"))).alias(f"b{i}") for i, x in enumerate(targets)]
    wide = runs.agg(*best)
    rows = F.explode(F.array(*(F.struct(F.lit(float(x)).alias("target"), F.col(f"b{i}").alias("qps")) for i, x in enumerate(targets)))).alias("r")
    return t.join(wide.select(rows).select("r.*"), "target", "left")


def qps_at_recall(runs: DataFrame, target: float, group: str = "engine") -> DataFrame:
    """qps interpolated at a recall between the two settings around it."""
    own = Window.partitionBy(group).orderBy("recall", F.desc("qps"))
    step = runs.withColumn("r0", F.lag("recall").over(own)).withColumn("q0", F.lag("qps").over(own))
    share = (F.lit(target) - F.col("r0")) / F.when(F.col("recall") > F.col("r0"), F.col("recall") - F.col("r0"))
    crossing = step.where((F.col("recall") >= target) & (F.col("r0").isNull() | (F.col("r0") < target)))
    return crossing.select(group, rounded(F.coalesce(F.col("q0") + share * (F.col("qps") - F.col("q0")), F.col("qps"))).alias("qps"))


def cheapest(runs: DataFrame, target: float, group: str = "engine") -> DataFrame:
    return runs.where(F.col("recall") >= target).groupBy(group).agg(F.min("setting").alias("setting"))


def monotone(runs: DataFrame, group: str = "engine") -> DataFrame:
    """Whether recall never falls as the setting grows."""
    own = Window.partitionBy(group).orderBy("setting")
    return runs.withColumn("up", F.coalesce(F.col("recall") >= F.lag("recall").over(own), F.lit(True))).groupBy(group).agg(F.bool_and("up").alias("monotone"))


def short_results(found: DataFrame, k: int) -> DataFrame:
    """Share of rows of found(n_found, n_matching) with fewer than min(k, n_matching) hits."""
    return found.agg(rounded(F.avg((F.col("n_found") < F.least(F.lit(k), "n_matching")).cast("double"))).alias("short_rate"))


def tag_clustered(rows: DataFrame, n: int) -> DataFrame:
    """rows(id) with tagged for the n smallest ids."""
    return rows.join(rows.orderBy("id").limit(n).select("id", F.lit(True).alias("tagged")), "id", "left").fillna(False, ["tagged"])


def tag_semantic(rows: DataFrame, n: int) -> DataFrame:
    """rows(id, distance to an anchor) with tagged for the n nearest."""
    near = rows.orderBy("distance", "id").limit(n).select("id", F.lit(True).alias("tagged"))
    return rows.join(near, "id", "left").fillna(False, ["tagged"])


def replace_trace(spark: SparkSession, pool: int, live: int, batch: int, cycles: int, seed: int = 42, kinds: Sequence[str] = ("insert", "update", "delete", "replace"), slices: int = 1) -> DataFrame:
    """A deterministic change log: a build, then cycles of insert, update, delete and replace
    batches after each of which `live` ids are live again. With slices, a cycle deals its
    batches in that many turns, kinds interleaved; kinds=("replace",) is plain turnover.
    Columns seq, ts, op, id, source_row."""
    if not 0 < batch <= live or live + batch > pool:
        raise ValueError("a batch is at most the live rows, which with it are at most the pool")
    if not 0 < slices <= batch:
        raise ValueError("slices are at most the rows of a batch")
    if kinds.count("insert") != kinds.count("delete"):
        raise ValueError("inserts and deletes must balance")
    rng, ts, fresh, alive = np.random.default_rng(seed), 1, live, list(range(live))
    rows = [(ts, "upsert", i, i) for i in alive]
    for kind in [k for _ in range(cycles * slices) for k in kinds]:
        ts, n = ts + 1, batch // slices
        picked = [] if kind == "insert" else sorted(int(i) for i in rng.choice(alive, n, replace=False))
        if kind == "update":
            rows += [(ts, "upsert", i, int(rng.integers(pool))) for i in picked]
        elif picked:
            rows += [(ts, "delete", i, None) for i in picked]
            alive = sorted(set(alive).difference(picked))
        if kind in ("insert", "replace"):
            made, fresh = list(range(fresh, fresh + n)), fresh + n
            rows += [(ts, "upsert", i, i % pool) for i in made]
            alive += made
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "seq bigint, ts bigint, op string, id bigint, source_row bigint")


def gate(baseline: dict[str, float], now: dict[str, float], tolerance: dict[str, float], calibration: float = 1.0) -> dict[str, str]:
    """pass, fail or abstain per metric: relative change against a tolerance; a timing is
    scaled by the machine's calibration, and metrics missing on a side abstain."""
    out = {}
    for name, was in baseline.items():
        allowed = tolerance.get(name)
        if name not in now or allowed is None or not was:
            out[name] = "abstain"
        else:
            change = now[name] * (calibration if name.startswith(("qps", "ops")) else 1.0) / was - 1
            out[name] = "pass" if change >= -allowed else "fail"
    return out
