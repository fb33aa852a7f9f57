"""The engine's registered queries on the benchmark tables, with the same in SQL.

embeddings are the vectors; events are a change log (id = user_id, commit = event_id, an
error deletes, anything else upserts). Every query runs over its whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import filters, vectors
from tidemark.functions.ids import stable_ids
from tidemark.operators import branches, evaluate, knn, multivector, versions
from tidemark.session import shared_folder
from tidemark.sources import sql as sql_surface
from tidemark.sources.store import ChangeLog
from tidemark.streaming.cdc import commit_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def anchor(spark: SparkSession, d: str, i: int = 0) -> list[float]:
    return [float(x) for x in corpus(spark, d).where(F.col("id") == i).first().vector]


def twentieth(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).where(F.col("id") % 20 == 0).select(F.col("id").alias("qid"), "vector")


def log(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", versions.DELETE).otherwise(versions.UPSERT)
    return table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("ts"), F.lit(0).alias("seq"), op.alias("op"), "value", "event_type", "props")


def half(spark: SparkSession, d: str) -> int:
    return table(spark, d, "events").agg(F.max("event_id")).first()[0] // 2


_LOG = "(SELECT user_id AS id, event_id AS ts, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, value, event_type, props FROM events)"
_HALF = "(SELECT max(event_id) // 2 FROM events)"
_INTERVALS = f"(SELECT * FROM (SELECT id, ts AS begin_ts, lead(ts) OVER (PARTITION BY id ORDER BY ts) AS end_ts, op, value, event_type, props FROM {_LOG}) WHERE op = 'upsert')"
_VISIBLE = f"(SELECT * FROM {_INTERVALS} WHERE begin_ts <= {_HALF} AND (end_ts IS NULL OR end_ts > {_HALF}))"
_NOW = f"(SELECT id, value, event_type, props, begin_ts AS ts FROM {_INTERVALS} WHERE end_ts IS NULL)"
_COS = "round(1 - list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 6) + 0.0"
_L2 = "round(list_distance(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 6) + 0.0"
_Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def _near(metric: str = _COS, keep: str = "true", k: int = 10, rows: str = "embeddings") -> str:
    return f"SELECT vec_id AS id, {metric.format(a='embedding', b=_Q0)} AS distance FROM {rows} WHERE {keep} ORDER BY 2, 1 LIMIT {k}"


# --- search ---------------------------------------------------------------------------


@query(_near())
def knn_cosine(spark, d):
    return knn.exact(corpus(spark, d), anchor(spark, d), 10).select("id", "distance")


@query(_near(_L2))
def knn_l2(spark, d):
    return knn.exact(corpus(spark, d), anchor(spark, d), 10, "l2").select("id", "distance")


def _batch_sql(metric: str, k: int = 10) -> str:
    return f"""SELECT qid, id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM (
      SELECT q.vec_id AS qid, e.vec_id AS id, {metric.format(a='q.embedding', b='e.embedding')} AS distance
      FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)) WHERE rank <= {k}"""


@query(_batch_sql(_COS))
def knn_batch(spark, d):
    return knn.batch(corpus(spark, d), twentieth(spark, d), 10)


@query(_batch_sql(_L2))
def knn_batch_l2(spark, d):
    return knn.batch(corpus(spark, d), twentieth(spark, d), 10, "l2")


def _labelled(spark, d) -> DataFrame:
    return corpus(spark, d).withColumn("mask", F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("label")))


@query(_near(keep="(CAST(1 AS BIGINT) << label) & 6 <> 0"))
def knn_label_any(spark, d):
    return knn.exact(_labelled(spark, d), anchor(spark, d), 10, keep=filters.label_match("mask", require_any=6)).select("id", "distance")


@query(_near(keep="(CAST(1 AS BIGINT) << label) & 6 = 0"))
def knn_label_exclude(spark, d):
    return knn.exact(_labelled(spark, d), anchor(spark, d), 10, keep=filters.label_match("mask", exclude=6)).select("id", "distance")


@query(_near(keep="(CAST(1 AS BIGINT) << label) & 8 = 8"))
def knn_label_all(spark, d):
    return knn.exact(_labelled(spark, d), anchor(spark, d), 10, keep=filters.label_match("mask", require_all=8)).select("id", "distance")


@query(_near(keep="label >= 3 AND label NOT IN (5, 7)"))
def knn_where_exact(spark, d):
    return knn.exact(corpus(spark, d), anchor(spark, d), 10, keep=filters.where({"label": {"$gte": 3, "$nin": [5, 7]}})).select("id", "distance")


@query(f"SELECT id, distance FROM (SELECT vec_id AS id, label, {_COS.format(a='embedding', b=_Q0)} AS distance FROM embeddings ORDER BY 3, 1 LIMIT 80) WHERE label >= 3 ORDER BY 2, 1 LIMIT 10")
def knn_overfetch(spark, d):
    return knn.over_fetched(corpus(spark, d), anchor(spark, d), 10, filters.where({"label": {"$gte": 3}})).select("id", "distance")


@query(f"SELECT vec_id AS id, round(1 - distance, 6) AS similarity FROM (SELECT vec_id, {_COS.format(a='embedding', b=_Q0)} AS distance FROM embeddings ORDER BY 2, 1 LIMIT 4)")
def similarity_search(spark, d):
    return knn.exact(corpus(spark, d), anchor(spark, d), 4).select("id", F.round(1 - F.col("distance"), 6).alias("similarity"))


@query(f"SELECT '[' || string_agg('{{\"id\":' || id || '}}', ',' ORDER BY distance, id) || ']' AS hits FROM ({_near()})")
def knn_json(spark, d):
    found = knn.exact(corpus(spark, d), anchor(spark, d), 10).select("id", "distance")
    ordered = F.array_sort(F.collect_list(F.struct("distance", "id")))
    return found.agg(F.to_json(F.transform(ordered, lambda x: F.struct(x["id"].alias("id")))).alias("hits"))


@query(_near())
def knn_table_function(spark, d):
    changes = corpus(spark, d).select("id", F.lit(1).cast("bigint").alias("ts"), F.lit(0).alias("seq"), F.lit("upsert").alias("op"), "vector")
    changes.createOrReplaceTempView("tidemark_knn_changes")
    sql_surface.register(spark, "tidemark_knn", "tidemark_knn_changes")
    values = ", ".join(f"CAST({x!r} AS DOUBLE)" for x in anchor(spark, d))
    return spark.sql(f"SELECT id, distance FROM tidemark_knn(array({values}), 10, 1)")


@query(f"""SELECT id, {_COS.format(a='v', b=_Q0)} AS distance FROM (
  SELECT vec_id % 100 AS id, arg_max(embedding, vec_id) AS v FROM embeddings WHERE vec_id <= (SELECT max(vec_id) * 2 // 3 FROM embeddings) GROUP BY 1) ORDER BY 2, 1 LIMIT 10""")
def knn_as_of(spark, d):
    rows = corpus(spark, d)
    t = rows.agg(F.max("id")).first()[0] * 2 // 3
    changes = rows.select((F.col("id") % 100).alias("id"), F.col("id").alias("ts"), F.lit(0).alias("seq"), F.lit("upsert").alias("op"), "vector")
    return knn.exact(versions.as_of(versions.intervals(changes), t), anchor(spark, d), 10).select("id", "distance")


# --- pages ----------------------------------------------------------------------------

_CENTRES = "(SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i)"
_PAGES = f"(SELECT label AS page_id, list(m ORDER BY i) AS centroid FROM {_CENTRES} GROUP BY label)"


def pages(spark, d, metric: str = "l2") -> DataFrame:
    return vectors.centroids(corpus(spark, d), "label", "vector", metric).withColumnRenamed("label", "page_id")


@query(f"SELECT label AS page_id, CAST(i - 1 AS INTEGER) AS i, round(m, 6) + 0.0 AS m FROM {_CENTRES}")
def centroid_by_label(spark, d):
    return pages(spark, d).select("page_id", F.posexplode("centroid").alias("i", "m")).withColumn("m", vectors.rounded(F.col("m")))


@query(f"SELECT page_id, max({_L2.format(a='embedding', b='centroid')}) AS radius, count(*) AS live, bit_or(CAST(1 AS BIGINT) << (vec_id % 8)) AS label_union FROM embeddings JOIN {_PAGES} ON label = page_id GROUP BY 1")
def page_radius(spark, d):
    rows = corpus(spark, d).withColumn("page_id", F.col("label")).withColumn("mask", F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("id") % 8).cast("int")))
    return knn.page_stats(rows, pages(spark, d), "mask").select("page_id", vectors.rounded(F.col("radius")).alias("radius"), "live", "label_union")


@query(f"""SELECT page_id, round(greatest(gap - radius, 0) * greatest(gap - radius, 0), 6) + 0.0 AS bound FROM (
  SELECT page_id, list_distance(CAST({_Q0} AS DOUBLE[]), any_value(centroid)) AS gap, max(list_distance(CAST(embedding AS DOUBLE[]), centroid)) AS radius
  FROM embeddings JOIN {_PAGES} ON label = page_id GROUP BY 1)""")
def page_lower_bound(spark, d):
    own = knn.page_stats(corpus(spark, d).withColumn("page_id", F.col("label")), pages(spark, d))
    gap = vectors.distance("centroid", F.array(*(F.lit(x) for x in anchor(spark, d))), "l2") - F.col("radius")
    return own.select("page_id", vectors.rounded(vectors.page_bound(gap, "l2")).alias("bound"))


@query(f"SELECT page_id, {_L2.format(a='centroid', b=_Q0)} AS gap FROM {_PAGES} ORDER BY 2, 1 LIMIT 3")
def ivf_route(spark, d):
    return knn.route(pages(spark, d), anchor(spark, d), 3, "l2").select("page_id", "gap")


_ROUTED = _near(_L2, f"label IN (SELECT page_id FROM (SELECT page_id, {_L2.format(a='centroid', b=_Q0)} AS gap FROM {_PAGES} ORDER BY 2, 1 LIMIT 3))")


@query(_ROUTED)
def ivf_knn(spark, d):
    rows = corpus(spark, d).withColumn("page_id", F.col("label"))
    return knn.routed(rows, pages(spark, d), anchor(spark, d), 10, 3, "l2").select("id", "distance")


@query(f"SELECT round(count(*) / 10.0, 6) AS recall FROM ({_ROUTED}) r JOIN ({_near(_L2)}) e ON r.id = e.id")
def ivf_recall(spark, d):
    qid = F.lit(0).alias("qid")
    found, truth = ivf_knn(spark, d).select(qid, "id"), knn_l2(spark, d).select(qid, "id")
    return evaluate.recall_per_query(found, truth, 10).select("recall")


@query(_near(_L2))
def knn_bounded_pages(spark, d):
    rows = corpus(spark, d).withColumn("page_id", F.col("label"))
    own = knn.page_stats(rows, pages(spark, d))
    return knn.bounded(rows, own, anchor(spark, d), 10, 2).select("id", "distance")


@query("SELECT label AS page_id, count(*) AS live, count(*) FILTER (vec_id % 8 IN (1, 2)) AS matching FROM embeddings GROUP BY 1")
def page_label_profile(spark, d):
    rows = corpus(spark, d).select(F.col("label").alias("page_id"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("id") % 8).cast("int")).alias("mask"))
    return versions.page_profile(rows, filters.label_match("mask", require_any=6))


@query("SELECT label AS page_id, bit_or(CAST(1 AS BIGINT) << (vec_id % 8)) & 6 <> 0 AS can_match FROM embeddings GROUP BY 1")
def page_can_match(spark, d):
    rows = corpus(spark, d).select(F.col("label").alias("page_id"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("id") % 8).cast("int")).alias("mask"))
    return rows.groupBy("page_id").agg(F.bit_or("mask").alias("u")).select("page_id", filters.page_can_match("u", require_any=6).alias("can_match"))


@query(f"""SELECT vec_id AS id, page_id FROM (SELECT vec_id, page_id, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_distance(CAST(embedding AS DOUBLE[]), centroid), 9), page_id) AS r
  FROM embeddings, {_PAGES}) WHERE r = 1""")
def page_assignment(spark, d):
    return knn.assign(corpus(spark, d).select("id", "vector"), pages(spark, d)).select("id", F.col("page_id").cast("int").alias("page_id"))


_GAPS = f"(SELECT page_id, {_L2.format(a='centroid', b=_Q0)} AS gap FROM {_PAGES})"
_HELD = f"(SELECT *, row_number() OVER (ORDER BY gap, page_id) AS place, sum(n) OVER (ORDER BY gap, page_id) AS matches FROM {_GAPS} JOIN (SELECT label AS page_id, count(*) AS n FROM embeddings WHERE vec_id % 8 IN (1, 2) GROUP BY 1) USING (page_id))"


@query(_near(_L2, f"vec_id % 8 IN (1, 2) AND label IN (SELECT page_id FROM {_HELD} WHERE place <= (SELECT pow(2, ceil(log2(coalesce(min(place) FILTER (matches >= 30), max(place))))) FROM {_HELD}))", 30))
def ivf_widening(spark, d):
    rows = corpus(spark, d).withColumn("page_id", F.col("label"))
    return knn.widened(rows, pages(spark, d), anchor(spark, d), 30, F.pmod("id", F.lit(8)).isin(1, 2)).select("id", "distance")


_SKETCH = "list_transform(CAST({v} AS DOUBLE[]), lambda x: CAST(greatest(-127, least(127, round(x * 127))) AS BIGINT))"
_ROUGH = f"(SELECT vec_id, embedding FROM (SELECT vec_id, embedding, list_sum(list_transform(list_zip({_SKETCH.format(v='embedding')}, {_SKETCH.format(v=_Q0)}), lambda z: z[1] * z[2])) AS s FROM embeddings) ORDER BY s DESC, vec_id LIMIT 64)"


@query(_near(rows=_ROUGH))
def knn_screened(spark, d):
    return knn.screened(corpus(spark, d), anchor(spark, d), 10).select("id", "distance")


@query(f"""SELECT count(DISTINCT label) AS pages, count(*) AS versions, count(*) FILTER (NOT seen) AS mvcc_filtered, count(*) FILTER (seen) AS candidates FROM (
  SELECT label, b <= t AND (e IS NULL OR e > t) AS seen FROM (SELECT vec_id AS b, label, lead(vec_id) OVER (PARTITION BY vec_id % 100 ORDER BY vec_id) AS e, (SELECT max(vec_id) * 2 // 3 FROM embeddings) AS t FROM embeddings)
  WHERE label IN (SELECT page_id FROM {_GAPS} ORDER BY gap, page_id LIMIT 3))""")
def search_metrics(spark, d):
    rows = corpus(spark, d)
    t = rows.agg(F.max("id")).first()[0] * 2 // 3
    changes = rows.select((F.col("id") % 100).alias("id"), F.col("id").alias("ts"), F.lit(0).alias("seq"), F.lit("upsert").alias("op"), F.col("label").alias("page_id"))
    return knn.search_metrics(versions.intervals(changes), pages(spark, d), anchor(spark, d), 3, t)


# --- vector functions -----------------------------------------------------------------


@query(f"""SELECT vec_id AS id, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST({_Q0} AS DOUBLE[])), 6) + 0.0 AS dot,
  {_L2.format(a='embedding', b=_Q0)} AS l2, {_COS.format(a='embedding', b=_Q0)} AS cosine,
  round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings""")
def vector_scalars(spark, d):
    q = F.array(*(F.lit(x) for x in anchor(spark, d)))
    r = vectors.rounded
    return corpus(spark, d).select("id", r(vectors.dot("vector", q)).alias("dot"), r(vectors.l2_distance("vector", q)).alias("l2"), r(vectors.cosine_distance("vector", q)).alias("cosine"), r(vectors.norm("vector")).alias("norm"))


@query("SELECT vec_id AS id, CAST(list_sum(list_transform(embedding, lambda x: abs(greatest(-127, least(127, round(CAST(x AS DOUBLE) * 127)))))) AS BIGINT) AS weight FROM embeddings")
def vector_sketch(spark, d):
    return corpus(spark, d).select("id", F.aggregate(vectors.sketch8("vector"), F.lit(0).cast("bigint"), lambda s, x: s + F.abs(x)).alias("weight"))


@query(f"""SELECT id, round(peak, 6) AS peak, CAST(list_sum(list_transform(r, lambda x: abs(round(x / peak * 7)))) AS BIGINT) AS weight FROM (
  SELECT id, r, list_max(list_transform(r, lambda x: abs(x))) AS peak FROM (SELECT vec_id AS id, list_transform(list_zip(CAST(embedding AS DOUBLE[]), centroid), lambda x: x[1] - x[2]) AS r FROM embeddings JOIN {_PAGES} ON label = page_id))""")
def vector_residual(spark, d):
    rows = corpus(spark, d).join(pages(spark, d), F.col("label") == F.col("page_id")).select("id", vectors.residual4("vector", "centroid").alias("r"))
    return rows.select("id", F.round("r.peak", 6).alias("peak"), F.aggregate("r.codes", F.lit(0).cast("bigint"), lambda s, x: s + F.abs(x)).alias("weight"))


_MINUS = "list_transform(list_zip(CAST({a} AS DOUBLE[]), centroid), lambda z: z[1] - z[2])"


@query(f"""SELECT id, round(greatest(list_inner_product(f, f) + list_inner_product(o, o) - 2 * CASE WHEN list_inner_product(c, o) > 0 THEN list_inner_product(c, f) * list_inner_product(o, o) / list_inner_product(c, o) ELSE 0 END, 0), 5) + 0.0 AS estimate FROM (
  SELECT id, f, o, list_transform(o, lambda x: round(x / peak * 7)) AS c FROM (SELECT id, f, o, list_max(list_transform(o, lambda x: abs(x))) AS peak FROM (
  SELECT vec_id AS id, {_MINUS.format(a=_Q0)} AS f, {_MINUS.format(a='embedding')} AS o FROM embeddings JOIN {_PAGES} ON label = page_id)))""")
def estimated_distance(spark, d):
    q = F.array(*(F.lit(x) for x in anchor(spark, d)))
    rows = corpus(spark, d).join(pages(spark, d), F.col("label") == F.col("page_id"))
    return rows.select("id", vectors.rounded(vectors.estimated_l2sq(q, "centroid", "vector"), 5).alias("estimate"))


@query("SELECT a.n_nationkey AS code, arg_min(b.r_regionkey, CAST(bit_count(xor(a.n_nationkey, b.r_regionkey)) AS BIGINT) * 100 + b.r_regionkey) AS nearest FROM nation a, region b GROUP BY 1")
def nearest_code(spark, d):
    codes, full = table(spark, d, "nation").select(F.col("n_nationkey").alias("code")), table(spark, d, "region").select(F.col("r_regionkey").alias("full"))
    both = codes.crossJoin(F.broadcast(full))  # regions are five rows
    return both.groupBy("code").agg(F.min_by("full", vectors.hamming("code", "full") * 100 + F.col("full")).alias("nearest"))


@query("""SELECT dimensions, vectors, 4 * dimensions * vectors AS vector_bytes, CAST(trunc((4 * dimensions * vectors + dimensions * vectors + 64 * vectors) * 1.5) AS BIGINT) AS total_bytes
  FROM (SELECT unnest([64, 128, 960]) AS dimensions), (SELECT CAST(unnest([1000, 1000000]) AS BIGINT) AS vectors)""")
def estimate_memory(spark, d):
    rows = [(n, v, e["vector_bytes"], e["total_bytes"]) for n in (64, 128, 960) for v in (1000, 1_000_000) for e in [vectors.estimate_memory(n, v)]]
    return spark.createDataFrame(rows, "dimensions int, vectors bigint, vector_bytes bigint, total_bytes bigint")


@query()
def stable_id(spark, d):
    """No blake2b in SQL."""
    return table(spark, d, "pages").select("url", stable_ids("url").alias("id"))


# --- versions -------------------------------------------------------------------------


@query(f"SELECT id, begin_ts, end_ts, value FROM {_INTERVALS}")
def version_intervals(spark, d):
    return versions.intervals(log(spark, d)).select("id", "begin_ts", "end_ts", "value")


@query(f"SELECT id, begin_ts, value FROM {_VISIBLE}")
def asof_view(spark, d):
    return versions.as_of(versions.intervals(log(spark, d)), half(spark, d)).select("id", "begin_ts", "value")


@query(f"SELECT count(*) AS n, round(sum(value), 4) AS total FROM {_VISIBLE}")
def asof_count(spark, d):
    return versions.latest(log(spark, d), half(spark, d)).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"SELECT id, ts, value, event_type FROM {_NOW}")
def current_view(spark, d):
    return versions.latest(log(spark, d)).select("id", "ts", "value", "event_type")


@query(f"SELECT id, coalesce(arg_max(props, ts) FILTER (ts <= {_HALF}), arg_min(props, ts)) AS props FROM {_LOG} WHERE op = 'upsert' GROUP BY id")
def metadata_asof(spark, d):
    history = log(spark, d).where(F.col("op") == "upsert").withColumnRenamed("ts", "stamp")
    return versions.value_as_of(history, half(spark, d), ["props"])


@query(f"SELECT id, arg_max(props, ts) AS props FROM {_LOG} WHERE op = 'upsert' AND ts <= {_HALF} // 50 GROUP BY id")
def record_asof(spark, d):
    history = log(spark, d).where(F.col("op") == "upsert").withColumnRenamed("ts", "stamp")
    return versions.value_as_of(history, half(spark, d) // 50, ["props"], earliest=False)


@query(f"""SELECT id, ts, m FROM (SELECT id, ts, op, last_value(m IGNORE NULLS) OVER (PARTITION BY id, spell ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM (
  SELECT id, ts, op, CASE WHEN event_type = 'view' OR op = 'delete' THEN NULL ELSE props END AS m,
    coalesce(sum(CASE WHEN op = 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spell FROM {_LOG})) WHERE op = 'upsert'""")
def carry_forward(spark, d):
    changes = log(spark, d).withColumn("m", F.when((F.col("event_type") != "view") & (F.col("op") == "upsert"), F.col("props")))
    return versions.carried_forward(changes, ["m"]).where(F.col("op") == "upsert").select("id", "ts", "m")


@query(f"SELECT id, event_type AS k, arg_max(props, ts) AS v FROM {_LOG} GROUP BY 1, 2")
def metadata_merge(spark, d):
    changes = log(spark, d).withColumn("metadata", F.create_map("event_type", "props"))
    return versions.merged_metadata(changes).select("id", F.explode("metadata").alias("k", "v"))


_K = "CAST(regexp_extract(props, '[0-9]+') AS INTEGER)"
_WHERE = {"$or": [{"k": {"$gt": 50}}, {"event_type": {"$in": ["view", "click"]}}], "value": {"$lt": 40}, "missing": {"$ne": "x"}}
_WHERE_SQL = f"({_K} > 50 OR event_type IN ('view', 'click')) AND value < 40"


def _fields(name, want=None):
    return F.col(name) if name in ("event_type", "value") else filters.json_field("props")(name, want)


@query(f"SELECT id, value, event_type FROM {_NOW} WHERE {_WHERE_SQL}")
def current_where(spark, d):
    return versions.latest(log(spark, d)).where(filters.where(_WHERE, _fields)).select("id", "value", "event_type")


@query(f"SELECT id, value FROM {_NOW} WHERE NOT ({_WHERE_SQL})")
def delete_where(spark, d):
    live = versions.latest(log(spark, d))
    return live.join(live.where(filters.where(_WHERE, _fields)).select("id"), "id", "left_anti").select("id", "value")


@query(f"SELECT id, (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY id) AS ts, 'delete' AS op FROM (SELECT DISTINCT id FROM {_NOW} WHERE id % 5 = 0)")
def batch_delete(spark, d):
    live = versions.latest(log(spark, d))
    base = table(spark, d, "events").agg(F.max("event_id")).first()[0]
    asked = table(spark, d, "events").where(F.col("user_id") % 5 == 0).select(F.col("user_id").alias("id")).distinct().withColumn("pos", F.col("id"))
    return versions.delete_changes(live, asked, base).select("id", "ts", "op")


@query(f"SELECT DISTINCT id FROM {_LOG} EXCEPT SELECT id FROM {_NOW}")
def unknown_ids(spark, d):
    return versions.unknown_ids(versions.latest(log(spark, d)), log(spark, d).select("id").distinct()).select("id")


@query(f"SELECT id, begin_ts, end_ts FROM {_INTERVALS} WHERE end_ts < {_HALF} ORDER BY end_ts, begin_ts, id LIMIT 500")
def vacuum_reclaimed(spark, d):
    return versions.reclaimable(versions.intervals(log(spark, d)), half(spark, d), 500).select("id", "begin_ts", "end_ts")


@query(f"SELECT id, begin_ts FROM {_INTERVALS} EXCEPT SELECT id, begin_ts FROM (SELECT id, begin_ts, end_ts FROM {_INTERVALS} WHERE end_ts < {_HALF} ORDER BY end_ts, begin_ts, id LIMIT 500)")
def vacuum_retained(spark, d):
    return versions.vacuumed(versions.intervals(log(spark, d)), half(spark, d), 500).select("id", "begin_ts")


@query(f"SELECT id, ts AS stamp FROM (SELECT id, ts, sum(CASE WHEN ts <= {_HALF} THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY ts DESC) AS old FROM {_LOG} WHERE op = 'upsert') WHERE old <= 1")
def prune_history(spark, d):
    history = log(spark, d).where(F.col("op") == "upsert").withColumnRenamed("ts", "stamp")
    return versions.pruned(history, half(spark, d)).select("id", "stamp")


@query(f"SELECT count(*) FILTER (end_ts IS NULL) AS live, count(*) FILTER (end_ts IS NOT NULL) AS retained, round(count(*) / count(*) FILTER (end_ts IS NULL), 6) AS amplification, (SELECT max(event_id) FROM events) AS clock FROM {_INTERVALS}")
def version_stats(spark, d):
    clock = versions.clock(log(spark, d)).first().clock
    return versions.stats(versions.intervals(log(spark, d)), clock)


@query(f"""SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'replaced' END AS change
  FROM {_VISIBLE} a FULL JOIN {_NOW} b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.begin_ts <> b.ts""")
def snapshot_diff(spark, d):
    own = versions.intervals(log(spark, d))
    return versions.snapshot_diff(own, half(spark, d), versions.clock(log(spark, d)).first().clock)


@query(f"""SELECT t AS snapshot, count(*) FILTER (seen) AS live, count(*) FILTER (NOT seen) AS retained, round(count(*) / count(*) FILTER (seen), 6) AS amplification FROM (
  SELECT t, end_ts IS NULL OR end_ts > t AS seen FROM {_INTERVALS}, (SELECT (SELECT max(event_id) FROM events) * unnest([1, 2, 3, 4]) // 4 AS t) WHERE begin_ts <= t) GROUP BY 1""")
def churn_cycles(spark, d):
    last = table(spark, d, "events").agg(F.max("event_id")).first()[0]
    return versions.stats_at(versions.intervals(log(spark, d)), [last * i // 4 for i in (1, 2, 3, 4)])


@query(f"SELECT id, value FROM {_NOW}")
def log_replay(spark, d):
    shadow = log(spark, d).select(F.col("ts").alias("seq"), F.when(F.col("op") == "upsert", 1).otherwise(2).alias("op"), "id", F.array("value").alias("vector"))
    return sql_surface.replayed(shadow).select("id", F.col("vector")[0].alias("value"))


# --- branches -------------------------------------------------------------------------

_BASE = f"(SELECT id, value, event_type FROM {_VISIBLE})"
_DELTA = f"(SELECT id, ts, op, value, event_type FROM {_LOG} WHERE ts > {_HALF} AND id % 3 = 0)"
_NET = f"(SELECT id, arg_max(op, ts) AS op, arg_max(value, ts) AS value, arg_max(event_type, ts) AS event_type FROM {_DELTA} GROUP BY id)"
_MAIN = f"(SELECT id, ts, op, value, event_type FROM {_LOG} WHERE id % 3 <> 0 OR ts <= {_HALF} OR ts % 7 = 0)"


def _fork(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    t, changes = half(spark, d), log(spark, d)
    base = versions.latest(changes, t).select("id", "value", "event_type")
    delta = changes.where((F.col("ts") > t) & (F.col("id") % 3 == 0)).select("id", F.col("ts").alias("seq"), "op", "value", "event_type")
    main = changes.where((F.col("id") % 3 != 0) | (F.col("ts") <= t) | (F.col("ts") % 7 == 0)).select("id", "ts", "seq", "op", "value", "event_type")
    return base, delta, main, t


@query(f"SELECT id, value, event_type FROM {_BASE} WHERE id NOT IN (SELECT id FROM {_NET}) UNION ALL SELECT id, value, event_type FROM {_NET} WHERE op = 'upsert'")
def branch_overlay(spark, d):
    base, delta, _, _ = _fork(spark, d)
    return branches.overlay(base, delta)


@query(f"SELECT id, op FROM {_NET}")
def branch_diff(spark, d):
    return branches.diff(_fork(spark, d)[1])


@query(f"SELECT DISTINCT id FROM {_DELTA} WHERE id IN (SELECT id FROM {_MAIN} WHERE ts > {_HALF})")
def branch_conflicts(spark, d):
    _, delta, main, t = _fork(spark, d)
    return branches.conflicts(main, delta, t)


_MAIN_NOW = f"(SELECT id, arg_max(op, ts) AS op, arg_max(value, ts) AS value FROM {_MAIN} GROUP BY id)"


@query(f"SELECT id, value FROM {_MAIN_NOW} WHERE op = 'upsert' AND id NOT IN (SELECT id FROM {_NET}) UNION ALL SELECT id, value FROM {_NET} WHERE op = 'upsert'")
def branch_merge(spark, d):
    _, delta, main, t = _fork(spark, d)
    done = branches.merged(main, delta, t, versions.clock(main).first().clock + 1)
    return versions.latest(done).select("id", "value")


@query(f"""SELECT id, {_COS.format(a='v', b=_Q0)} AS distance FROM (
  SELECT vec_id AS id, embedding AS v FROM embeddings WHERE vec_id % 7 NOT IN (1, 2) UNION ALL
  SELECT a.vec_id, b.embedding FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1 WHERE a.vec_id % 7 = 1) ORDER BY 2, 1 LIMIT 10""")
def branch_knn(spark, d):
    rows = corpus(spark, d).select("id", "vector")
    moved = rows.where(F.col("id") % 7 == 0).select((F.col("id") + 1).alias("id"), "vector").join(rows.select("id"), "id", "left_semi")
    delta = moved.withColumn("op", F.lit("upsert")).unionByName(rows.where(F.col("id") % 7 == 2).withColumn("op", F.lit("delete"))).withColumn("seq", F.lit(1).cast("bigint"))
    return knn.exact(branches.overlay(rows, delta), anchor(spark, d), 10).select("id", "distance")


@query("""WITH RECURSIVE up(node, depth) AS (SELECT CAST((SELECT max(user_id) FROM events) AS VARCHAR), 0
  UNION ALL SELECT CAST(CAST(node AS BIGINT) // 2 AS VARCHAR), depth + 1 FROM up WHERE CAST(node AS BIGINT) > 0)
  SELECT node, depth FROM up""")
def branch_ancestors(spark, d):
    users = table(spark, d, "events").agg(F.max("user_id").alias("m"))
    nodes = users.select(F.explode(F.sequence(F.lit(0).cast("bigint"), "m")).alias("n"))
    parent = F.when(F.col("n") > 0, F.floor(F.col("n") / 2).cast("string"))
    nodes.select(F.col("n").cast("string").alias("node"), parent.alias("parent")).createOrReplaceTempView("tidemark_parents")
    return branches.ancestors(spark, "tidemark_parents", str(users.first().m))


_NODES = "(SELECT n AS node, CASE WHEN n > 0 THEN n // 2 END AS parent, coalesce(visits, 0) AS visits, coalesce(value, 0) AS value FROM (SELECT unnest(range(0, (SELECT max(user_id) + 1 FROM events))) AS n) LEFT JOIN (SELECT user_id, count(*) AS visits, sum(value) AS value FROM events GROUP BY 1) ON n = user_id)"
_UP = f"(WITH RECURSIVE up(node, top) AS (SELECT node, node FROM {_NODES} UNION ALL SELECT up.node, p.parent FROM up JOIN {_NODES} p ON p.node = up.top WHERE p.parent IS NOT NULL) SELECT top AS node, sum(visits) AS visits, sum(value) AS value FROM up JOIN {_NODES} USING (node) GROUP BY 1)"


def _tree(spark, d) -> DataFrame:
    users = table(spark, d, "events").agg(F.max("user_id").alias("m")).select(F.explode(F.sequence(F.lit(0).cast("bigint"), "m")).alias("node"))
    seen = table(spark, d, "events").groupBy(F.col("user_id").alias("node")).agg(F.count(F.lit(1)).alias("visits"), F.sum("value").alias("value"))
    parent = F.when(F.col("node") > 0, F.floor(F.col("node") / 2))
    return users.join(seen, "node", "left").select("node", parent.alias("parent"), F.coalesce("visits", F.lit(0)).alias("visits"), F.coalesce("value", F.lit(0.0)).alias("value"))


@query(f"SELECT node, CAST(visits AS BIGINT) AS visits, round(value, 3) + 0.0 AS value FROM {_UP}")
def tree_backprop(spark, d):
    return branches.backpropagated(_tree(spark, d)).select("node", "visits", vectors.rounded(F.col("value"), 3).alias("value"))


@query(f"""SELECT parent, arg_min(node, (-s, node)) AS node FROM (
  SELECT c.parent, c.node, CASE WHEN u.visits > 0 THEN round(u.value / u.visits + 1.4 * sqrt(ln(greatest(p.visits, 1)) / u.visits), 9) ELSE CAST('inf' AS DOUBLE) END AS s
  FROM {_NODES} c JOIN {_UP} u ON u.node = c.node JOIN {_UP} p ON p.node = c.parent) GROUP BY 1""")
def tree_select(spark, d):
    return branches.selected(branches.backpropagated(_tree(spark, d)))


@query(f"""SELECT user_id AS id, min(value) AS distance FROM events WHERE event_type IN ('view', 'click') GROUP BY 1 ORDER BY 2, 1 LIMIT 10""")
def chain_search(spark, d):
    hits = table(spark, d, "events").select(F.col("event_type").alias("node"), F.col("user_id").alias("id"), F.col("value").alias("distance"))
    return branches.nearest_of_chain(hits, spark.createDataFrame([("view",), ("click",)], "node string"), 10)


# --- multi-vector ---------------------------------------------------------------------

_CHAMFER = """(SELECT doc_id, round(sum(s), 6) + 0.0 AS score FROM (
  SELECT t.vec_id // 8 AS doc_id, q.vec_id AS q, max(list_inner_product(CAST(t.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) AS s
  FROM embeddings t, embeddings q WHERE q.vec_id < 4 GROUP BY 1, 2) GROUP BY 1)"""


def _tokens(spark, d) -> tuple[DataFrame, list[list[float]]]:
    rows = corpus(spark, d)
    asked = [[float(x) for x in r.vector] for r in rows.where(F.col("id") < 4).orderBy("id").collect()]
    return rows.select(F.floor(F.col("id") / 8).cast("bigint").alias("doc_id"), (F.col("id") % 8).cast("int").alias("tok"), "vector"), asked


@query(f"SELECT doc_id, score FROM {_CHAMFER}")
def chamfer_scores(spark, d):
    return multivector.chamfer(*_tokens(spark, d))


@query(f"SELECT doc_id, score FROM {_CHAMFER} ORDER BY score DESC, doc_id LIMIT 10")
def chamfer_top(spark, d):
    return multivector.top_documents(*_tokens(spark, d), 10)


@query(f"""SELECT doc_id, score FROM {_CHAMFER} WHERE doc_id IN (SELECT id // 8 FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, r) AS n FROM (
  SELECT q.vec_id AS q, t.vec_id AS id, {_COS.format(a='q.embedding', b='t.embedding')} AS distance, t.vec_id AS r FROM embeddings q, embeddings t WHERE q.vec_id < 4)) WHERE n <= 25)
  ORDER BY score DESC, doc_id LIMIT 10""")
def token_search(spark, d):
    return multivector.token_search(*_tokens(spark, d), 10)


@query()
def encoded_search(spark, d):
    """Seeded hyperplanes are not SQL."""
    tokens, asked = _tokens(spark, d)
    return multivector.encoded_search(tokens, asked, 10, multivector.Encoder(len(asked[0]), 3, 4))


# --- evaluation -----------------------------------------------------------------------

_RUNS = f"(SELECT event_type AS engine, {_K} // 10 AS setting, round(({_K} // 10 + 1) * 0.099, 6) AS recall, round(avg(value) * 100 / ({_K} // 10 + 1), 6) AS qps FROM events GROUP BY 1, 2)"


def _runs(spark, d) -> DataFrame:
    k = F.floor(F.regexp_extract("props", "[0-9]+", 0).cast("int") / 10).cast("int")
    rows = table(spark, d, "events").select(F.col("event_type").alias("engine"), k.alias("setting"), "value")
    means = rows.groupBy("engine", "setting").agg(F.avg("value").alias("m"))
    return means.select("engine", "setting", F.round((F.col("setting") + 1) * 0.099, 6).alias("recall"), F.round(F.col("m") * 100 / (F.col("setting") + 1), 6).alias("qps"))


@query(f"SELECT target, (SELECT max(qps) FROM {_RUNS} WHERE recall >= target) AS qps FROM (SELECT CAST(unnest([0.5, 0.9, 0.999]) AS DOUBLE) AS target)")
def recall_frontier(spark, d):
    return evaluate.frontier(_runs(spark, d), [0.5, 0.9, 0.999])


@query(f"""SELECT engine, round(coalesce(q0 + (0.75 - r0) / (recall - r0) * (qps - q0), qps), 6) + 0.0 AS qps FROM (
  SELECT *, lag(recall) OVER (PARTITION BY engine ORDER BY recall, qps DESC) AS r0, lag(qps) OVER (PARTITION BY engine ORDER BY recall, qps DESC) AS q0 FROM {_RUNS})
  WHERE recall >= 0.75 AND (r0 IS NULL OR r0 < 0.75)""")
def qps_at_recall(spark, d):
    return evaluate.qps_at_recall(_runs(spark, d), 0.75)


@query(f"SELECT engine, min(setting) AS setting FROM {_RUNS} WHERE recall >= 0.75 GROUP BY 1")
def cheapest_setting(spark, d):
    return evaluate.cheapest(_runs(spark, d), 0.75)


@query(f"SELECT engine, bool_and(up) AS monotone FROM (SELECT engine, coalesce(recall >= lag(recall) OVER (PARTITION BY engine ORDER BY setting), true) AS up FROM {_RUNS}) GROUP BY 1")
def monotone_curve(spark, d):
    return evaluate.monotone(_runs(spark, d))


@query("""SELECT event_type, count(value) AS n, round(avg(value), 6) + 0.0 AS mean, round(quantile_cont(value, 0.5), 6) + 0.0 AS p50, round(quantile_cont(value, 0.95), 6) + 0.0 AS p95,
  round(quantile_cont(value, 0.99), 6) + 0.0 AS p99 FROM events GROUP BY 1""")
def latency_percentiles(spark, d):
    return evaluate.latency(table(spark, d, "events"), "value", ["event_type"])


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) + 0.0 AS mean, round(1.96 * stddev_samp(value) / sqrt(count(value)), 6) + 0.0 AS half_width FROM events GROUP BY 1")
def confidence_interval(spark, d):
    return evaluate.confidence(table(spark, d, "events"), "value", ["event_type"])


_TRUTH10 = _batch_sql(_COS)


@query(f"""SELECT round(avg(recall), 6) + 0.0 AS mean, round(quantile_cont(recall, 0.05), 6) + 0.0 AS p05, round(quantile_cont(recall, 0.5), 6) + 0.0 AS p50,
  round(quantile_cont(recall, 0.95), 6) + 0.0 AS p95, round(avg(CASE WHEN recall >= 1 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS perfect FROM (
  SELECT qid, round(sum(CASE WHEN label < 7 THEN 1 ELSE 0 END) / 10.0, 6) AS recall FROM ({_TRUTH10}) JOIN embeddings ON id = vec_id GROUP BY 1)""")
def recall_quality(spark, d):
    truth = knn_batch(spark, d).select("qid", "id")
    found = truth.join(corpus(spark, d).where(F.col("label") < 7).select("id"), "id", "left_semi")
    return evaluate.quality(evaluate.recall_per_query(found, truth, 10))


@query(f"""SELECT round(avg(CASE WHEN found < least(10, matching) THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS short_rate FROM (
  SELECT qid, count(*) FILTER (e.label = q.label) AS found, any_value(m.n) AS matching FROM ({_batch_sql(_COS, 80)})
  JOIN embeddings e ON id = e.vec_id JOIN embeddings q ON qid = q.vec_id JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) m ON m.label = q.label GROUP BY 1)""")
def short_result_rate(spark, d):
    rows = corpus(spark, d).select("id", "label")
    near = knn.batch(corpus(spark, d), twentieth(spark, d), 80).select("qid", "id")
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_matching"))
    asked = rows.select(F.col("id").alias("qid"), F.col("label").alias("wanted"))
    both = near.join(rows, "id").join(asked, "qid")
    found = both.groupBy("qid", "wanted").agg(F.count_if(F.col("label") == F.col("wanted")).alias("n_found"))
    return evaluate.short_results(found.join(sizes.withColumnRenamed("label", "wanted"), "wanted"), 10)


@query(f"SELECT vec_id AS id, row_number() OVER (ORDER BY {_COS.format(a='embedding', b=_Q0)}, vec_id) <= 50 AS tagged FROM embeddings")
def tag_semantic(spark, d):
    rows = knn.with_distance(corpus(spark, d), anchor(spark, d)).select("id", "distance")
    return evaluate.tag_semantic(rows, 50).select("id", "tagged")


@query("SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) <= 50 AS tagged FROM embeddings")
def tag_clustered(spark, d):
    return evaluate.tag_clustered(corpus(spark, d).select("id"), 50)


@query()
def replace_trace(spark, d):
    """Random by seed: checked by its invariants in the tests."""
    return evaluate.replace_trace(spark, 3000, 1000, 100, 2)


@query()
def mixed_trace(spark, d):
    """Random by seed, its kinds interleaved: checked by its invariants in the tests."""
    return evaluate.replace_trace(spark, 3000, 1000, 96, 2, slices=8)


# --- documents ------------------------------------------------------------------------


@query("SELECT doc_id, lang FROM documents WHERE regexp_matches(coalesce(text, ''), '[0-9]{3}-[0-9]{4}') AND lang IN ('en', 'de')")
def where_regex(spark, d):
    return table(spark, d, "documents").where(filters.where({"text": {"$regex": "[0-9]{3}-[0-9]{4}"}, "lang": {"$in": ["en", "de"]}})).select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE (contains(text, 'licensed') OR n_chars > 10000) AND lang <> 'fr'")
def where_contains(spark, d):
    return table(spark, d, "documents").where(filters.where({"$or": [{"text": {"$contains": "licensed"}}, {"n_chars": {"$gt": 10000}}], "lang": {"$ne": "fr"}})).select("doc_id")


# --- storage and streams --------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tidemark-store-{uuid.uuid4().hex}"


@query("SELECT vec_id AS id, label FROM embeddings WHERE label <> 3")
def store_round_trip(spark, d):
    """Two commits to a change log on storage, read back."""
    own = ChangeLog(spark, f"{_folder(spark)}/log", len(anchor(spark, d)))
    rows = corpus(spark, d).withColumn("label", F.col("label").cast("bigint"))
    own.append(rows.withColumn("op", F.lit("upsert")))
    own.append(rows.where(F.col("label") == 3).select("id", F.lit("delete").alias("op")))
    return own.live().select("id", F.col("label").cast("int").alias("label"))


@query("SELECT vec_id AS id, CAST(CASE WHEN vec_id % 4 = 0 THEN label + 10 ELSE label END AS INTEGER) AS label FROM embeddings WHERE vec_id % 4 <> 1")
def store_apply_changes(spark, d):
    """Checked upserts and deletes in one commit, then a compaction."""
    own = ChangeLog(spark, f"{_folder(spark)}/log", len(anchor(spark, d)))
    rows = corpus(spark, d).withColumn("label", F.col("label").cast("bigint"))
    own.apply_changes(rows)
    own.apply_changes(rows.where(F.col("id") % 4 == 0).withColumn("label", F.col("label") + 10), rows.where(F.col("id") % 4 == 1))
    own.compact(4)
    return own.live().select("id", F.col("label").cast("int").alias("label"))


@query(f"SELECT id, event_type FROM {_NOW}")
def stream_cdc(spark, d):
    """The events as a stream of changes, committed batch by batch."""
    folder = _folder(spark)
    own = ChangeLog(spark, f"{folder}/log", 1, "l2")
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    changes = events.select(op.alias("op"), F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.array("value").alias("vector"), F.col("event_type").alias("document"))
    commit_stream(changes, own, f"{folder}/checkpoint").awaitTermination()
    return own.live().select("id", F.col("document").alias("event_type"))
