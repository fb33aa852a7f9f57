"""SQL surface: a table function and a JSON function over a collection's rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def _sum(inner: str) -> str:
    return f"aggregate({inner}, CAST(0 AS DOUBLE), (s, x) -> s + x)"


def register(spark: SparkSession, name: str, changes_view: str, metric: str = "cosine") -> None:
    """Temporary functions over a view of changes (id, ts, seq, op, vector):

    SELECT * FROM <name>(query, k, snapshot)        -- id, distance
    SELECT <name>_json(query, k, snapshot)          -- the same as a JSON list
    """
    for n in (name, changes_view):
        if not _NAME.match(n):
            raise ValueError(f"{n!r} is no identifier")
    dot = lambda a, b: _sum(f"zip_with({a}, {b}, (p, q) -> CAST(p AS DOUBLE) * q)")
    l2 = _sum("zip_with(v, query, (p, q) -> (CAST(p AS DOUBLE) - q) * (CAST(p AS DOUBLE) - q))")
    expression = f"sqrt({l2})" if metric == "l2" else f"1 - {dot('v', 'query')} / sqrt({dot('v', 'v')} * {dot('query', 'query')})"
    live = f"""SELECT id, max_by(vector, struct(ts, seq)) AS v, max_by(op, struct(ts, seq)) AS op
               FROM {changes_view} WHERE ts <= snapshot GROUP BY id"""
    ranked = f"""SELECT id, distance FROM (
          SELECT id, distance, row_number() OVER (ORDER BY distance, id) AS r
          FROM (SELECT id, round({expression}, 6) + 0D AS distance FROM ({live}) WHERE op = 'upsert')) WHERE r <= k"""
    head = "query ARRAY<DOUBLE>, k INT, snapshot BIGINT"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({head}) RETURNS TABLE(id BIGINT, distance DOUBLE) RETURN {ranked}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_json({head}) RETURNS STRING RETURN (SELECT to_json(transform(array_sort(collect_list(struct(distance, id))), x -> struct(x.id AS id, x.distance AS distance))) FROM ({ranked}))")


def ingest(spark: SparkSession, table: str, id_column: str, vector_column: str) -> DataFrame:
    """id and vector of a table by name; names must be plain identifiers."""
    for n in (*table.split("."), id_column, vector_column):
        if not _NAME.match(n):
            raise ValueError(f"{n!r} is no identifier")
    return spark.table(table).select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<float>").alias("vector"))


def replayed(log: DataFrame) -> DataFrame:
    """The live rows of a shadow log (seq, op 1 = put or 2 = remove, id, vector)."""
    newest = log.groupBy("id").agg(F.max_by(F.struct("op", "vector"), "seq").alias("n"))
    return newest.where("n.op = 1").select("id", "n.vector")
