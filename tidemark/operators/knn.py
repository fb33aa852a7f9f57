"""Nearest neighbours: exact, batched, filtered, routed and over-fetched.

Ranks are by (distance rounded to six digits, id), so ties are settled by id. The batch
search sends the queries in blocks of a fixed number of rows, whatever their number, and
keeps the k best of each query in every task before anything is shuffled. A task takes
distances in tiles of a fixed size, so it holds the block of queries, their k best and a
tile, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.vectors import distance, distances, rounded, sketch8, units
from tidemark.operators.versions import visible

QUERY_BLOCK = 16_384
#: neighbours that a task keeps for a block of queries, 24 bytes each; a larger k has smaller blocks
KEPT = 1 << 21
#: queries and rows whose distances are held at once
TILE = 256, 2_048
DIGITS = 6
NEAR = np.dtype([("q", "<i8"), ("d", "<f8"), ("id", "<i8")])


def _literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def with_distance(corpus: DataFrame, vector: Sequence[float], metric: str = "cosine") -> DataFrame:
    return corpus.withColumn("distance", rounded(distance("vector", _literal(vector), metric), DIGITS))


def exact(corpus: DataFrame, vector: Sequence[float], k: int, metric: str = "cosine", keep: Column | None = None) -> DataFrame:
    """The k nearest rows of corpus(id, vector, ...); keep filters before distances are taken."""
    if k < 0:
        raise ValueError("k is negative")
    rows = corpus if keep is None else corpus.where(keep)
    return with_distance(rows, vector, metric).orderBy("distance", "id").limit(k)


def over_fetched(corpus: DataFrame, vector: Sequence[float], k: int, keep: Column, metric: str = "cosine", overfetch: int = 8) -> DataFrame:
    """At most k of the nearest k * overfetch rows that hold `keep`."""
    return exact(corpus, vector, k * max(1, overfetch), metric).where(keep).orderBy("distance", "id").limit(k)


def batch(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", query_block: int = QUERY_BLOCK) -> DataFrame:
    """qid, id, distance, rank: the k nearest rows of corpus(id, vector) of each of queries(qid, vector)."""
    # the queries' number is counted, and each pass over the corpus carries one block of them
    n = queries.count()
    passes = max(1, -(-n // max(1, min(query_block, KEPT // max(1, k)))))
    spot = F.pmod(F.xxhash64("qid"), F.lit(passes))
    found = None
    for p in range(passes):
        rows = (queries if passes == 1 else queries.where(spot == p)).select("qid", "vector").collect()
        part = _one_pass(corpus, [r.qid for r in rows], [r.vector for r in rows], k, metric)
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("qid").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


class _Nearest:
    """The k nearest rows so far of each of a tile's queries, in order of query, distance, id."""

    def __init__(self, queries: np.ndarray, k: int, metric: str):
        self.queries, self.k, self.metric = queries, k, metric
        self.best = np.empty(0, dtype=NEAR)
        # distance and id of each query's k-th; no distance is beyond nan, which stands where fewer are kept
        self.last, self.last_id = np.full(len(queries), np.nan), np.zeros(len(queries), dtype=np.int64)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        found, n = [], 0
        for lo in range(0, len(rows), TILE[1]):
            part = self._within(ids[lo : lo + TILE[1]], distances(self.queries, rows[lo : lo + TILE[1]], self.metric))
            found, n = [*found, part], n + len(part)
            if n > self.k * len(self.queries):
                self._keep(found)
                found, n = [], 0
        if n:
            self._keep(found)

    def _within(self, ids: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The rows that may be among the k nearest. Bounds on unrounded distances leave out
        only what is beyond the k-th when rounded too."""
        near = ~(d > _above(self.last)[:, None])
        if d.shape[1] > self.k and np.count_nonzero(near) > 2 * self.k * len(d):
            near &= ~(d > _above(np.partition(d, self.k - 1, axis=1)[:, self.k - 1])[:, None])
        q, at = np.nonzero(near)
        part = np.empty(len(q), dtype=NEAR)
        part["q"], part["d"], part["id"] = q, np.round(d[q, at], DIGITS) + 0.0, ids[at]
        last = self.last[q]
        return part[~((part["d"] > last) | ((part["d"] == last) & (part["id"] > self.last_id[q])))]

    def _keep(self, found: list[np.ndarray]) -> None:
        rows = np.concatenate([self.best, *found])
        rows = rows[np.lexsort((rows["id"], rows["d"], rows["q"]))]
        sizes = np.bincount(rows["q"], minlength=len(self.queries))
        place = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.best = rows[place < self.k]
        full = rows[place == self.k - 1]
        self.last[full["q"]], self.last_id[full["q"]] = full["d"], full["id"]


def _above(d: np.ndarray) -> np.ndarray:
    """Beyond every distance that is d when rounded, or is rounded to what d is rounded to."""
    return d + (2 * 10**-DIGITS + 1e-14 * np.abs(d))


def _one_pass(corpus: DataFrame, qids: list[int], vectors: list, k: int, metric: str) -> DataFrame:
    spark = corpus.sparkSession
    q = np.array(vectors, dtype=np.float64).reshape(len(qids), -1 if qids else 0)
    sent = spark.sparkContext.broadcast((np.array(qids, dtype=np.int64), units(q) if metric == "cosine" and len(q) else q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_q, own = sent.value
        kept = [_Nearest(own[lo : lo + TILE[0]], k, metric) for lo in range(0, len(own) if k > 0 else 0, TILE[0])]
        for b in batches:
            if not b.num_rows or not kept:
                continue
            ids = b.column(0).to_numpy()
            rows = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
            rows = units(rows) if metric == "cosine" else rows
            for near in kept:
                near.add(ids, rows)
        for i, near in enumerate(kept):
            best = near.best
            yield pa.RecordBatch.from_arrays([pa.array(ids_q[best["q"] + i * TILE[0]]), pa.array(best["id"]), pa.array(best["d"])], names=["qid", "id", "distance"])

    return corpus.select(F.col("id").cast("bigint"), "vector").mapInArrow(run, T.StructType.fromDDL("qid bigint, id bigint, distance double"))


def route(pages: DataFrame, vector: Sequence[float], nprobe: int, metric: str = "cosine") -> DataFrame:
    """The nprobe pages of pages(page_id, centroid, ...) nearest to a vector."""
    near = pages.withColumn("gap", rounded(distance("centroid", _literal(vector), metric), DIGITS))
    return near.orderBy("gap", "page_id").limit(nprobe)


def routed(corpus: DataFrame, pages: DataFrame, vector: Sequence[float], k: int, nprobe: int, metric: str = "cosine", keep: Column | None = None) -> DataFrame:
    """The k nearest rows of corpus(id, vector, page_id) within the nprobe nearest pages; a
    corpus partitioned by page_id reads those pages only."""
    chosen = route(pages, vector, nprobe, metric).select("page_id")
    return exact(corpus.join(chosen, "page_id", "left_semi"), vector, k, metric, keep)


def bounded(corpus: DataFrame, pages: DataFrame, vector: Sequence[float], k: int, nprobe: int, metric: str = "l2") -> DataFrame:
    """Exact top k in two passes: the routed pages give a bound on the k-th distance, then
    only pages(page_id, centroid, radius) whose lower bound is within it are read."""
    first = routed(corpus, pages, vector, k, nprobe, metric)
    found = [r.distance for r in first.select("distance").collect()]  # k rows
    bound = max(found) if len(found) == k else float("inf")
    gap = distance("centroid", _literal(vector), "l2") - F.col("radius")
    least = F.sqrt(gap * gap) if metric == "l2" else gap * gap / 2
    within = pages.where((gap <= 0) | (least <= bound + 10**-DIGITS)).select("page_id")
    return exact(corpus.join(within, "page_id", "left_semi"), vector, k, metric)


def assign(corpus: DataFrame, pages: DataFrame, metric: str = "l2") -> DataFrame:
    """corpus(id, vector) with the page_id of its nearest centroid. The directory of pages is
    collected: it has one row per page, of which there are at most a few thousand by design."""
    rows = pages.select("page_id", "centroid").orderBy("page_id").collect()
    ids, table = np.array([r.page_id for r in rows], dtype=np.int64), np.array([r.centroid for r in rows], dtype=np.float64)
    sent = corpus.sparkSession.sparkContext.broadcast((ids, units(table) if metric == "cosine" else table))
    at = corpus.columns.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, centres = sent.value
        for b in batches:
            x = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, centres.shape[1]).astype(np.float64)
            x = units(x) if metric == "cosine" and len(x) else x
            near = page[np.round(distances(x, centres, metric), 9).argmin(1)] if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near)], names=[*b.schema.names, "page_id"])

    return corpus.mapInArrow(run, T.StructType([*corpus.schema.fields, T.StructField("page_id", T.LongType())]))


def build_pages(corpus: DataFrame, capacity: int = 1024, sample: int = 65_536, rounds: int = 8, metric: str = "l2", seed: int = 7) -> DataFrame:
    """pages(page_id, centroid) by k-means on a bounded sample, about `capacity` rows a page."""
    if capacity < 8:
        raise ValueError("a page holds 8 rows at least")
    spark, total = corpus.sparkSession, corpus.count()
    rows = corpus.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("vector").collect()
    x = np.array([r.vector for r in rows], dtype=np.float64)
    if not len(x):
        return spark.createDataFrame([], "page_id bigint, centroid array<double>")
    x = units(x) if metric == "cosine" else x
    k = max(1, min(len(x), 4096, round(total / capacity)))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = distances(x, centres, metric).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        counts = np.bincount(at, minlength=k)[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
        centres = units(centres) if metric == "cosine" else centres
    return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "page_id bigint, centroid array<double>")


def page_stats(corpus: DataFrame, pages: DataFrame, label: str | None = None) -> DataFrame:
    """pages with radius, live and label_union from their members."""
    joined = corpus.join(pages.select("page_id", "centroid"), "page_id")
    unions = [F.bit_or(label).alias("label_union")] if label else []
    stats = joined.groupBy("page_id").agg(F.max(distance("vector", "centroid", "l2")).alias("radius"), F.count(F.lit(1)).alias("live"), *unions)
    return pages.join(stats, "page_id", "left")


def widened(corpus: DataFrame, pages: DataFrame, vector: Sequence[float], k: int, keep: Column, nprobe: int = 1, metric: str = "l2") -> DataFrame:
    """Filtered routed search that fills k: of the pages that hold a match, the nearest nprobe
    are taken, then twice as many, until they hold k matches or all are taken. How many are
    needed is read off one count per page, so there is one search, not one per doubling."""
    held = corpus.where(keep).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    near = pages.join(held, "page_id").withColumn("gap", rounded(distance("centroid", _literal(vector), metric), DIGITS))
    order = Window.orderBy("gap", "page_id")  # over the directory: a row per page
    ranked = near.select("page_id", F.row_number().over(order).alias("place"), F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("matches"))
    enough = F.coalesce(F.min(F.when(F.col("matches") >= k, F.col("place"))), F.max("place"))
    probes = F.lit(nprobe) * F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(enough / F.lit(nprobe))), F.lit(0)))
    taken = ranked.crossJoin(F.broadcast(ranked.agg(probes.alias("probes")))).where("place <= probes").select("page_id")
    return exact(corpus.join(taken, "page_id", "left_semi"), vector, k, metric, keep)


def screened(corpus: DataFrame, vector: Sequence[float], k: int, factor: int = 4, least: int = 64) -> DataFrame:
    """Two stages over unit vectors: the best max(k * factor, least) by the product of signed
    bytes, then exact cosine distances of those."""
    products = F.zip_with(sketch8("vector"), sketch8(_literal(vector)), lambda x, y: x * y)
    rough = corpus.withColumn("rough", F.aggregate(products, F.lit(0), lambda s, x: s + x))
    return exact(rough.orderBy(F.desc("rough"), "id").limit(max(k * factor, least)).drop("rough"), vector, k)


def search_metrics(versions: DataFrame, pages: DataFrame, vector: Sequence[float], nprobe: int, t: int, metric: str = "l2") -> DataFrame:
    """What a routed search of versions(id, page_id, begin_ts, end_ts) as of t looks at: pages,
    versions in them, those not visible at t, and candidates that are left."""
    chosen = route(pages, vector, nprobe, metric).select("page_id")
    inside = versions.join(chosen, "page_id", "left_semi")
    seen = F.coalesce(visible(t), F.lit(False))
    return inside.agg(F.count_distinct("page_id").alias("pages"), F.count(F.lit(1)).alias("versions"), F.count_if(~seen).alias("mvcc_filtered"), F.count_if(seen).alias("candidates"))
