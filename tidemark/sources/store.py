"""The change log on storage: data first, a commit record last.

A commit writes its rows to a folder of its own and then publishes one small record
naming it, by an atomic rename that fails if the record exists. Readers see what the
records name, so a crash in between leaves nothing visible and a batch is seen whole or
not at all. There is one writer at a time. Paths are Hadoop paths: any store will do.

    <root>/_config.json               dimensions, metric
    <root>/_commits/<ts>.json         ts, path, counts, batch_id
    <root>/data/<uuid>/*.parquet      rows of one commit, or of a compaction
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.vectors import METRICS
from tidemark.operators.versions import DELETE, UPSERT, intervals, latest, vacuumed

COLUMNS = "seq bigint, ts bigint, op string, id bigint, name string, vector array<float>, label bigint, metadata string, document string"
META = "meta"


class Files:
    """A folder through Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway, self.root = spark.sparkContext._jvm, spark.sparkContext._gateway, root.rstrip("/")
        self.path, self.conf = self.jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(self.root).getFileSystem(self.conf)

    def at(self, name: str) -> Any:
        return self.path(f"{self.root}/{name}" if name else self.root)

    def write(self, name: str, text: str, replace: bool = False) -> None:
        """Whole or not at all; without replace an existing file is an error. A reader of a
        file being replaced sees the old one or the new one."""
        if not replace and self.fs.exists(self.at(name)):
            raise FileExistsError(name)
        temp = self.at(f"_tmp/{uuid.uuid4().hex}")
        out = self.fs.create(temp)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.mkdirs(self.at(name).getParent())
        if replace:
            option = self.jvm.org.apache.hadoop.fs.Options.Rename
            options = self.gateway.new_array(option, 1)
            options[0] = option.OVERWRITE
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
            context.rename(self.fs.makeQualified(temp), self.fs.makeQualified(self.at(name)), options)
            return
        if not self.fs.rename(temp, self.at(name)):
            raise FileExistsError(name)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self.at(folder)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(folder)))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def delete(self, name: str = "") -> None:
        self.fs.delete(self.at(name) if name else self.path(self.root), True)


@dataclass(frozen=True)
class Commit:
    ts: int
    upserts: int
    deletes: int


class ChangeLog:
    def __init__(self, spark: SparkSession, root: str, dimensions: int | None = None, metric: str = "cosine"):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        if self.files.exists("_config.json"):
            config = json.loads(self.files.read("_config.json"))
            if dimensions not in (None, config["dimensions"]):
                raise ValueError(f"the log has {config['dimensions']} dimensions, not {dimensions}")
            self.dimensions, self.metric = config["dimensions"], config["metric"]
            return
        if not dimensions or dimensions <= 0:
            raise ValueError("dimensions must be positive")
        if metric not in METRICS:
            raise ValueError(f"metric is {metric!r}, not one of {METRICS}")
        self.dimensions, self.metric = dimensions, metric
        self.files.write("_config.json", json.dumps({"dimensions": dimensions, "metric": metric}))

    def _records(self) -> list[dict]:
        return [json.loads(self.files.read(f"_commits/{n}")) for n in self.files.names("_commits") if n.endswith(".json")]

    def clock(self) -> int:
        """The last committed timestamp; zero before the first."""
        names = [n for n in self.files.names("_commits") if n.endswith(".json")]
        return int(names[-1].removesuffix(".json")) if names else 0

    def commits(self) -> DataFrame:
        rows = [(r["ts"], r["upserts"], r["deletes"], r.get("batch_id")) for r in self._records()]
        return self.spark.createDataFrame(rows, "ts bigint, n_upsert bigint, n_delete bigint, batch_id bigint")

    def changes(self) -> DataFrame:
        paths = list(dict.fromkeys(r["path"] for r in self._records() if r["path"]))
        if not paths:
            return self.spark.createDataFrame([], COLUMNS)
        return self.spark.read.schema(COLUMNS).parquet(*(f"{self.root}/{p}" for p in paths))

    def _checked(self, rows: DataFrame) -> DataFrame:
        zero = F.forall("vector", lambda x: x == 0) if self.metric == "cosine" else F.lit(False)
        unsound = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        problem = (
            F.when(F.col("id").isNull(), "an id is null")
            .when(F.col("vector").isNotNull() & (F.size("vector") != self.dimensions), f"a vector has not {self.dimensions} dimensions")
            .when(F.col("vector").isNotNull() & unsound, "a vector is not finite")
            .when(F.col("vector").isNotNull() & zero, "a zero vector has no direction")
        )
        return rows.withColumn("id", F.when(problem.isNull(), F.col("id")).otherwise(F.raise_error(problem)))

    def append(self, rows: DataFrame, ts: int | None = None, batch_id: int | None = None) -> Commit:
        """One commit of rows(op, id, ...), seen whole or not at all. A batch_id that is
        committed already is not applied again."""
        now = self.clock()
        if batch_id is not None:
            for r in self._records():
                if r.get("batch_id") == batch_id:
                    return Commit(r["ts"], r["upserts"], r["deletes"])
        ts = now + 1 if ts is None else ts
        if ts <= now:
            raise ValueError(f"commit {ts} is not after the clock {now}")
        have, kinds = set(rows.columns), [x.strip().split(" ", 1) for x in COLUMNS.split(",")]
        own = {"seq": F.lit(0).cast("bigint"), "ts": F.lit(ts).cast("bigint")}
        shaped = rows.select(*((own[c] if c == "ts" or (c == "seq" and c not in have) else F.col(c).cast(k) if c in have else F.lit(None).cast(k)).alias(c) for c, k in kinds))
        path = f"data/{uuid.uuid4().hex}"
        self._checked(shaped).write.parquet(f"{self.root}/{path}")
        written = self.spark.read.schema(COLUMNS).parquet(f"{self.root}/{path}")
        n = {r.op: r.n for r in written.groupBy("op").agg(F.count(F.lit(1)).alias("n")).collect()}
        record = {"ts": ts, "path": path, "upserts": n.get(UPSERT, 0), "deletes": n.get(DELETE, 0), "batch_id": batch_id}
        self.files.write(f"_commits/{ts:020d}.json", json.dumps(record))
        return Commit(ts, record["upserts"], record["deletes"])

    def apply_changes(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, ts: int | None = None) -> Commit:
        """Upserts(id, vector, ...) and deletes(id) in one commit. All is checked before anything
        is written: an id given twice or on both sides is a ValueError, a delete of an id that
        is not live a KeyError."""
        sides = [x for x in (None if upserts is None else upserts.withColumn("op", F.lit(UPSERT)), None if deletes is None else deletes.select("id", F.lit(DELETE).alias("op"))) if x is not None]
        if not sides:
            raise ValueError("no changes are given")
        rows = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1], allowMissingColumns=True)
        asked = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("op").alias("least"), F.max("op").alias("most"))
        live = self.live().select(F.col("id").alias("known"))
        told = asked.join(live, asked["id"] == live["known"], "left")
        problem = F.when(F.col("least") != F.col("most"), "both").when(F.col("n") > 1, "twice").when((F.col("least") == DELETE) & F.col("known").isNull(), "unknown")
        wrong = told.select("id", problem.alias("p")).where("p is not null").orderBy("id").first()
        if wrong:
            if wrong.p == "unknown":
                raise KeyError(wrong.id)
            raise ValueError(f"id {wrong.id} is {'deleted and upserted' if wrong.p == 'both' else 'given twice'}")
        return self.append(rows, ts)

    def versions(self) -> DataFrame:
        return intervals(self.changes().where(F.col("op") != META))

    def live(self, t: int | None = None) -> DataFrame:
        return latest(self.changes().where(F.col("op") != META), t)

    def vacuum(self, oldest: int, budget: int = 0, readers: tuple[int, ...] = ()) -> int:
        """Rewrites the log without versions that ended before `oldest`; returns how many went.
        The rewrite is a new folder that all records then name, published record by record
        from the newest, so a reader between them sees a version at most twice, never a gap."""
        changes = self.changes()
        data, meta = changes.where(F.col("op") != META), changes.where(F.col("op") == META)
        before = self.versions()
        kept = vacuumed(before, oldest, budget, readers)
        stays = kept.select("id", F.col("begin_ts").alias("ts"))
        ends = kept.where("end_ts is not null").select("id", F.col("end_ts").alias("ts"))
        needed = stays.unionByName(ends).distinct()
        path = f"data/{uuid.uuid4().hex}"
        rest = data.join(needed, ["id", "ts"], "left_semi")
        rest = rest.where(F.col("op") == UPSERT).unionByName(rest.where(F.col("op") == DELETE))
        rest.unionByName(meta.join(stays.select("id").distinct(), "id", "left_semi")).select(*changes.columns).write.parquet(f"{self.root}/{path}")
        gone = before.count() - kept.count()
        self._publish(path)
        return gone

    def _publish(self, path: str) -> None:
        old = {r["path"] for r in self._records()} - {path}
        for r in reversed(self._records()):
            self.files.write(f"_commits/{r['ts']:020d}.json", json.dumps(r | {"path": path}), replace=True)
        for p in old:
            self.files.delete(p)

    def compact(self, files: int) -> None:
        """Rewrites the rows of all commits, the whole history, as about `files` files of id
        ranges, so that small commits do not stay small files and reads by id skip most."""
        path = f"data/{uuid.uuid4().hex}"
        self.changes().repartitionByRange(files, "id").sortWithinPartitions("id", "ts", "seq").write.parquet(f"{self.root}/{path}")
        self._publish(path)

    def checkpoint(self, path: str) -> None:
        """A copy of the whole log: data folders first, the manifest that names them last."""
        out = ChangeLog(self.spark, path, self.dimensions, self.metric)
        name = f"data/{uuid.uuid4().hex}"
        self.changes().write.parquet(f"{out.root}/{name}")
        for r in self._records():
            out.files.write(f"_commits/{r['ts']:020d}.json", json.dumps(r | {"path": name}))
