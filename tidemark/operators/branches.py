"""Branches over a versioned table: overlay, diff, conflicts, merge.

A branch is a fork timestamp and its own change rows delta(id, seq, op, ...). All touched
ids are taken out of the base before the delta's live rows are added, so a read never
sees a base version that the branch has replaced or deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.versions import DELETE, UPSERT, latest
from tidemark.session import cut

FAIL, LAST_WRITER = "fail_on_conflict", "last_writer_wins"


def net(delta: DataFrame) -> DataFrame:
    """The last change of each touched id."""
    rest = [c for c in delta.columns if c != "id"]
    return delta.groupBy("id").agg(F.max_by(F.struct(*rest), F.col("seq")).alias("n")).select("id", "n.*")


def overlay(base: DataFrame, delta: DataFrame) -> DataFrame:
    """base(id, ...) as the branch sees it; delta has base's columns, seq and op."""
    last = net(delta)
    ours = last.where(F.col("op") == UPSERT).select(*base.columns)
    return base.join(last.select("id"), "id", "left_anti").unionByName(ours)


def diff(delta: DataFrame) -> DataFrame:
    """id and op of what the branch would promote."""
    return net(delta).select("id", "op")


def conflicts(main: DataFrame, delta: DataFrame, fork_ts: int) -> DataFrame:
    """Touched ids whose newest change in main(id, ts, ...) is after the fork."""
    moved = main.groupBy("id").agg(F.max("ts").alias("t")).where(F.col("t") > fork_ts)
    return delta.select("id").distinct().join(moved.select("id"), "id", "left_semi")


def promoted(main: DataFrame, delta: DataFrame, fork_ts: int, ts: int, strategy: str = LAST_WRITER) -> DataFrame:
    """The one commit that a merge appends to main: the branch's net changes at ts; deletes of
    ids that main no longer holds are left out. FAIL refuses a branch with conflicts."""
    if strategy not in (FAIL, LAST_WRITER):
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == FAIL and not conflicts(main, delta, fork_ts).isEmpty():
        raise ValueError("the branch conflicts with later changes of main")
    last, live = net(delta), latest(main).select("id")
    rows = last.where(F.col("op") == UPSERT).unionByName(last.where(F.col("op") == DELETE).join(live, "id", "left_semi"))
    return rows.withColumn("ts", F.lit(ts).cast("bigint"))


def merged(main: DataFrame, delta: DataFrame, fork_ts: int, ts: int, strategy: str = LAST_WRITER) -> DataFrame:
    rows = promoted(main, delta, fork_ts, ts, strategy)
    return main.unionByName(rows.select(*main.columns))


def ancestors(spark, parents: str, node: str) -> DataFrame:
    """node and depth of a branch and all its ancestors, by a recursive query over the view `parents`(node, parent)."""
    return spark.sql(
        f"""WITH RECURSIVE up(node, depth) AS (
              SELECT :node, 0 UNION ALL SELECT p.parent, up.depth + 1 FROM up JOIN {parents} p ON p.node = up.node WHERE p.parent IS NOT NULL)
            SELECT node, depth FROM up""",
        args={"node": node},
    )


def nearest_of_chain(hits: DataFrame, chain: DataFrame, k: int) -> DataFrame:
    """hits(node, id, distance) of a chain of branches: per id the least distance, the k least."""
    best = hits.join(chain.select("node"), "node", "left_semi").groupBy("id").agg(F.min("distance").alias("distance"))
    return best.orderBy("distance", "id").limit(k)


def backpropagated(nodes: DataFrame) -> DataFrame:
    """node, parent, visits and value of nodes(node, parent, visits, value), each with the sums
    of all that hangs below it. One join and sum per level, over sums that shrink upwards;
    a level is written to the checkpoint folder, so the plan does not grow with the depth."""
    nodes = cut(nodes)
    links = nodes.select("node", "parent")
    level = total = nodes.select("node", "visits", "value")
    while True:
        above = level.join(links, "node").where("parent is not null").groupBy(F.col("parent").alias("node"))
        level = cut(above.agg(F.sum("visits").alias("visits"), F.sum("value").alias("value")))
        if level.isEmpty():
            break
        total = total.unionByName(level)
    sums = total.groupBy("node").agg(F.sum("visits").alias("visits"), F.sum("value").alias("value"))
    return links.join(sums, "node")


def selected(nodes: DataFrame, explore: float = 1.4) -> DataFrame:
    """parent and node: of each parent's children in nodes(node, parent, visits, value) the one
    with the highest mean value plus explore * sqrt(ln(parent's visits) / visits); an unvisited
    child first, ties by node."""
    above = nodes.select(F.col("node").alias("parent"), F.col("visits").alias("tries"))
    both = nodes.join(above, "parent")
    visits = F.when(F.col("visits") > 0, F.col("visits"))
    bonus = F.lit(explore) * F.sqrt(F.log(F.greatest("tries", F.lit(1))) / visits)
    score = F.coalesce(F.round(F.col("value") / visits + bonus, 9), F.lit(float("inf")))
    ranked = both.select("parent", "node", score.alias("score"))
    return ranked.groupBy("parent").agg(F.min_by("node", F.struct((-F.col("score")).alias("s"), "node")).alias("node"))
