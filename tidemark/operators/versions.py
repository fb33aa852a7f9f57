"""Versions: a change log as half-open intervals, read as of any commit.

Changes are rows (id, ts, seq, op, ...): op is upsert or delete, ts the commit, seq the
order within it. A version is visible at t while begin_ts <= t < end_ts; an open one has
a null end_ts. All of it is windows and joins on the id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPSERT, DELETE = "upsert", "delete"


def _ordered() -> Window:
    return Window.partitionBy("id").orderBy("ts", "seq")


def intervals(changes: DataFrame) -> DataFrame:
    """Upserts with begin_ts and end_ts. A version that is replaced in its own commit is never visible and left out."""
    spans = changes.withColumn("end_ts", F.lead("ts").over(_ordered())).withColumnRenamed("ts", "begin_ts")
    return spans.where((F.col("op") == UPSERT) & (F.col("end_ts").isNull() | (F.col("end_ts") > F.col("begin_ts")))).drop("op")


def visible(t: int | Column) -> Column:
    t = F.lit(t) if isinstance(t, int) else t
    return (F.col("begin_ts") <= t) & (F.col("end_ts").isNull() | (t < F.col("end_ts")))


def as_of(versions: DataFrame, t: int) -> DataFrame:
    return versions.where(visible(t))


def latest(changes: DataFrame, t: int | None = None) -> DataFrame:
    """The live rows as of t, straight from the log: the newest change of each id by a
    partial aggregate, without sorting histories."""
    upto = changes if t is None else changes.where(F.col("ts") <= t)
    rest = [c for c in changes.columns if c != "id"]
    newest = upto.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("n"))
    return newest.select("id", "n.*").where(F.col("op") == UPSERT).drop("op")


def clock(commits: DataFrame) -> DataFrame:
    """The committed clock; zero before the first commit."""
    return commits.agg(F.coalesce(F.max("ts"), F.lit(0)).alias("clock"))


def value_as_of(history: DataFrame, t: int, columns: Sequence[str], earliest: bool = True) -> DataFrame:
    """Per id the values of the newest row of history(id, stamp, seq, ...) with stamp <= t;
    failing that, of the earliest (earliest=True) or none."""
    order, pack = F.struct("stamp", "seq"), F.struct(*columns)
    chosen = F.max_by(F.when(F.col("stamp") <= t, pack), F.when(F.col("stamp") <= t, order))
    value = F.coalesce(chosen, F.min_by(pack, order)) if earliest else chosen
    return history.groupBy("id").agg(value.alias("v")).where("v is not null").select("id", "v.*")


def carried_forward(changes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Omitted (null) values of an upsert are those of the version before; a delete forgets them."""
    lives = Window.partitionBy("id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    spell = F.coalesce(F.sum((F.col("op") == DELETE).cast("int")).over(lives), F.lit(0))
    marked = changes.withColumn("_spell", spell)
    own = Window.partitionBy("id", "_spell").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return marked.select(*(F.last(c, ignorenulls=True).over(own).alias(c) if c in columns else F.col(c) for c in changes.columns))


def merged_metadata(changes: DataFrame, column: str = "metadata") -> DataFrame:
    """id and the merge of its map column in log order, later values of a key winning: an
    aggregate per id and key, so no history is gathered."""
    pairs = changes.select("id", "ts", "seq", F.explode(column).alias("k", "v"))
    newest = pairs.groupBy("id", "k").agg(F.max_by("v", F.struct("ts", "seq")).alias("v"))
    return newest.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias(column))


def delete_changes(live: DataFrame, ids: DataFrame, base_ts: int) -> DataFrame:
    """A batch delete: one commit per row, in the order of ids(id, pos); unknown ids are left out."""
    known = ids.join(live.select("id"), "id", "left_semi")
    # positions are numbered over one user's request, not over a table
    nth = F.row_number().over(Window.orderBy("pos"))
    return known.select("id", (F.lit(base_ts) + nth).alias("ts"), F.lit(0).alias("seq"), F.lit(DELETE).alias("op"))


def unknown_ids(live: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.join(live.select("id"), "id", "left_anti")


def expired(versions: DataFrame, oldest: int) -> DataFrame:
    return versions.where(F.col("end_ts").isNotNull() & (F.col("end_ts") < oldest))


def reclaimable(versions: DataFrame, oldest: int, budget: int = 0, readers: Sequence[int] = ()) -> DataFrame:
    """What a vacuum removes: versions that ended before `oldest` and before every active
    reader's snapshot, first ended first, at most `budget` of them (0: all)."""
    horizon = min([oldest, *readers])
    rows = expired(versions, horizon)
    return rows.orderBy("end_ts", "begin_ts", "id").limit(budget) if budget else rows


def vacuumed(versions: DataFrame, oldest: int, budget: int = 0, readers: Sequence[int] = ()) -> DataFrame:
    """The versions that stay."""
    if not budget:
        return versions.where(F.col("end_ts").isNull() | (F.col("end_ts") >= min([oldest, *readers])))
    gone = reclaimable(versions, oldest, budget, readers).select("id", "begin_ts")
    return versions.join(gone, ["id", "begin_ts"], "left_anti")


def pruned(history: DataFrame, horizon: int, deleted: DataFrame | None = None) -> DataFrame:
    """history(id, stamp, seq, ...) without what no read at the horizon or later needs: per
    id the newest row with stamp <= horizon and all later ones stay; ids of
    deleted(id, deleted_at) before the horizon go."""
    newest = Window.partitionBy("id").orderBy(F.desc("stamp"), F.desc("seq"))
    old = F.sum((F.col("stamp") <= horizon).cast("int")).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    kept = history.withColumn("_old", old).where("_old <= 1").drop("_old")
    return kept if deleted is None else kept.join(deleted.where(F.col("deleted_at") < horizon).select("id"), "id", "left_anti")


def stats(versions: DataFrame, clock_ts: int) -> DataFrame:
    """live, retained (ended, not yet reclaimed), amplification and the clock."""
    live = F.count_if(F.col("end_ts").isNull())
    return versions.agg(
        live.alias("live"),
        F.count_if(F.col("end_ts").isNotNull()).alias("retained"),
        F.round(F.count(F.lit(1)) / F.when(live > 0, live), 6).alias("amplification"),
        F.lit(clock_ts).cast("bigint").alias("clock"),
    )


def page_profile(rows: DataFrame, matching: Column) -> DataFrame:
    """Per page: live rows and how many of them match."""
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("live"), F.count_if(matching).alias("matching"))


def snapshot_diff(versions: DataFrame, t1: int, t2: int) -> DataFrame:
    """id and change (added, removed, replaced) between two snapshots."""
    a = as_of(versions, t1).select("id", F.col("begin_ts").alias("b1"))
    b = as_of(versions, t2).select("id", F.col("begin_ts").alias("b2"))
    kind = F.when(F.col("b1").isNull(), "added").when(F.col("b2").isNull(), "removed").when(F.col("b1") != F.col("b2"), "replaced")
    return a.join(b, "id", "full").select("id", kind.alias("change")).where("change is not null")


def stats_at(versions: DataFrame, snapshots: Sequence[int]) -> DataFrame:
    """snapshot, live, retained and amplification as of each snapshot, in one pass: what every
    cycle of a churning table holds if nothing is reclaimed."""
    columns = []
    for i, t in enumerate(snapshots):
        columns += [F.count_if(visible(t)).alias(f"live{i}"), F.count_if(F.col("begin_ts") <= t).alias(f"all{i}")]
    wide = versions.agg(*columns)
    row = lambda i, t: F.struct(F.lit(t).cast("bigint").alias("snapshot"), F.col(f"live{i}").alias("live"), (F.col(f"all{i}") - F.col(f"live{i}")).alias("retained"))
    rows = wide.select(F.explode(F.array(*(row(i, t) for i, t in enumerate(snapshots)))).alias("r")).select("r.*")
    return rows.withColumn("amplification", F.round((F.col("live") + F.col("retained")) / F.when(F.col("live") > 0, F.col("live")), 6))
