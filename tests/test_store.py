import asyncio

import pytest
from pyspark.sql import functions as F

from tidemark.adapters import TextStore
from tidemark.collection import AsyncCollection, Client
from tidemark.memory import Memory
from tidemark.operators import multivector
from tidemark.sources.sql import ingest, register
from tidemark.sources.store import ChangeLog
from tidemark.streaming.cdc import commit_stream, rejected
from tidemark.tokens import TokenIndex

E4 = [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]


@pytest.fixture
def client(spark, tmp_path):
    return Client(spark, f"file://{tmp_path}/root")


def test_collection_life(client):
    c = client.create("docs", 4, "l2")
    c.add(["a", "b", 7], E4[:3], ["alpha", "beta", "gamma"], [{"lang": "en", "year": 1}, {"lang": "fr"}, {"lang": "en"}])
    t = c.snapshot()
    assert [r.id for r in c.query(E4[0], k=1)] == ["a"] and len(c) == 3 and 7 in c and "zz" not in c
    assert [r.id for r in c.query(E4[0], k=5, where_={"lang": "fr"})] == ["b"]
    assert c.query(E4[0], k=5, where_={"lang": "fr"}, exact=False)[0].document == "beta"
    c.update(["a"], metadatas=[{"year": 2}])
    assert c.get(["a"])[0].metadata == {"lang": "en", "year": 2} and c.get(["a"], snapshot=t)[0].metadata["year"] == 1
    c.add(["a"], [E4[3]])
    assert c.get(["a"])[0].document == "alpha" and c.query(E4[3], k=1)[0].id == "a" and c.query(E4[0], k=1, snapshot=t)[0].id == "a"
    assert c.delete(where_={"lang": "fr"}) == 1 and c.delete(["b"]) == 0 and c.count() == 2 and c.count(t) == 3
    assert [r.id for r in c.peek(1)] == [7]
    assert c.vacuum() > 0 and c.count() == 2
    assert client.list() == ["docs"] and client.get("docs").count() == 2
    client.reset()
    assert client.list() == []


def test_refusals(client):
    c = client.create("docs", 4)
    for call, error in [
        (lambda: c.add(["a", "a"], E4[:2]), ValueError),
        (lambda: c.add(["a"], E4[:2]), ValueError),
        (lambda: c.add([True], E4[:1]), TypeError),
        (lambda: c.add(["a"], E4[:1], metadatas=["x"]), TypeError),
        (lambda: c.add(["a"]), ValueError),
        (lambda: c.update(["a"], metadatas=[{}]), KeyError),
        (lambda: c.delete(), ValueError),
        (lambda: c.query([1, 0]), ValueError),
        (lambda: c.query(text="x"), ValueError),
        (lambda: client.create("docs", 4), ValueError),
        (lambda: client.create("../x", 4), ValueError),
        (lambda: client.get("none"), KeyError),
        (lambda: client.delete("none"), KeyError),
        (lambda: client.create("zero", 0), ValueError),
        (lambda: client.create("odd", 4, "hamming"), ValueError),
    ]:
        with pytest.raises(error):
            call()
    for bad in ([0, 0, 0, 0], [float("nan"), 0, 0, 1], [1, 0, 0], [float("inf"), 0, 0, 1]):
        with pytest.raises(Exception, match="vector"):
            c.add(["a"], [bad])
    assert c.snapshot() == 0 and c.count() == 0


def test_text_queries_and_async(client):
    c = client.create("docs", 2, "l2", embedding=lambda texts: [[len(t), t.count("a")] for t in texts])
    c.add(["x", "y"], documents=["aaa", "b"])
    assert c.query("aab", k=1)[0].id == "x"
    assert asyncio.run(AsyncCollection(c).count()) == 2


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "op string, id bigint, vector array<float>, label bigint")


def test_a_commit_is_seen_whole_or_not(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/log", 2)
    log.append(rows_of(spark, [("upsert", 1, [1.0, 0.0], 5), ("upsert", -1, [0.0, 1.0], 6)]))
    rows_of(spark, [("upsert", 2, [1.0, 0.0], 5)]).write.parquet(f"file://{tmp_path}/log/data/orphan")  # a crash before the record
    again = ChangeLog(spark, f"file://{tmp_path}/log")
    assert again.clock() == 1 and {r.id: r.label for r in again.live().collect()} == {1: 5, -1: 6}
    with pytest.raises(ValueError):
        log.append(rows_of(spark, [("delete", 1, None, None)]), ts=1)
    with pytest.raises(FileExistsError):
        log.files.write("_commits/00000000000000000001.json", "{}")
    done = log.append(rows_of(spark, [("delete", 1, None, None)]), batch_id=9)
    assert log.append(rows_of(spark, [("delete", -1, None, None)]), batch_id=9) == done and log.live().count() == 1
    log.checkpoint(f"file://{tmp_path}/copy")
    assert ChangeLog(spark, f"file://{tmp_path}/copy").live().count() == 1 and ChangeLog(spark, f"file://{tmp_path}/copy").live(1).count() == 2


def test_vacuum_keeps_what_snapshots_need(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/log", 1, "l2")
    for n in range(1, 7):
        log.append(rows_of(spark, [("upsert", 1, [float(n)], n)] + [("delete", 2, None, None) if n == 4 else ("upsert", 2, [float(n)], n)]))
    want = {t: {r.id: r.label for r in log.live(t).collect()} for t in (4, 5, 6)}
    assert log.vacuum(4) == 4
    assert {t: {r.id: r.label for r in log.live(t).collect()} for t in (4, 5, 6)} == want
    assert {r.id: r.label for r in log.versions().where("begin_ts <= 4 and (end_ts is null or end_ts > 4)").collect()} == want[4]


def test_memory_branches(spark, tmp_path):
    m = Memory(spark, f"file://{tmp_path}/mem", 4)
    m.add("refund", E4[0], {"revision": 1})
    m.add("shipping", E4[1], {"revision": 1})
    with m.branch("try") as b:
        b.add("refund", E4[2], {"revision": 2})
        b.delete("shipping")
        assert b.rows().count() == 1 and m.rows().count() == 2 and b.as_of_fork(E4[0], 5).count() == 2
        with pytest.raises(KeyError):
            b.delete("shipping")
        with pytest.raises(ValueError):
            m.branch("try")
        with pytest.raises(ValueError):
            m.purge(m.snapshot() + 2)
    assert m.branches() == {} and m.rows().count() == 2
    b = m.open("keep")
    assert m.open("keep").base == b.base
    b.add("new", E4[3])
    b.delete("shipping")
    m.add("shipping", E4[1], {"revision": 3})
    assert b.conflicts().count() == 1 and b.diff().count() == 2
    with pytest.raises(ValueError):
        b.merge("fail_on_conflict")
    assert b.merge() == 2 and m.branches() == {}
    assert sorted(r.name for r in m.rows().collect()) == ['"new"', '"refund"']
    for bad in (-1, m.snapshot() + 1):
        with pytest.raises(ValueError):
            m.branch("bad", bad)
    assert m.branch("empty", 0).rows().count() == 0


def test_stream_is_committed_once(spark, tmp_path):
    source, log = f"{tmp_path}/in", ChangeLog(spark, f"file://{tmp_path}/log", 1, "l2")
    for n in range(3):
        rows_of(spark, [("upsert", i, [float(n)], n) for i in range(5)]).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema("op string, id bigint, vector array<float>, label bigint").option("maxFilesPerTrigger", 1).parquet(source)
    commit_stream(stream(), log, f"{tmp_path}/checkpoint").awaitTermination()
    assert log.clock() == 3 and log.live().count() == 5
    commit_stream(stream(), log, f"{tmp_path}/checkpoint").awaitTermination()
    assert log.clock() == 3
    rows_of(spark, [("delete", 0, None, None)]).coalesce(1).write.mode("append").parquet(source)
    commit_stream(stream(), log, f"{tmp_path}/checkpoint", vacuum_every=1).awaitTermination()
    assert log.live().count() == 4
    assert rejected(log.changes(), 2).where(F.col("ts") > 2).count() == 0


def test_sql_surface(spark):
    spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id bigint, embedding array<float>").createOrReplaceTempView("items")
    rows = ingest(spark, "items", "id", "embedding")
    rows.select("id", F.lit(1).alias("ts"), F.lit(0).alias("seq"), F.lit("upsert").alias("op"), "vector").createOrReplaceTempView("item_changes")
    register(spark, "near", "item_changes", "l2")
    assert [tuple(r) for r in spark.sql("SELECT * FROM near(array(1D, 0D), 1, 9)").collect()] == [(1, 0.0)]
    assert spark.sql("SELECT near_json(array(1D, 0D), 1, 9) AS j").first().j == '[{"id":1,"distance":0.0}]'
    assert spark.sql("SELECT * FROM near(array(1D, 0D), 1, 0)").count() == 0
    for bad in ("items; drop", "a b"):
        with pytest.raises(ValueError):
            ingest(spark, bad, "id", "embedding")


def test_changes_are_checked_before_they_are_written(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/log", 1, "l2")
    ups = lambda *ids: rows_of(spark, [("upsert", i, [float(i)], i) for i in ids]).drop("op")
    outs = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id bigint")
    log.apply_changes(ups(1, 2, 3))
    for upserts, deletes, error in [(ups(4, 4), None, ValueError), (ups(4), outs(1, 1), ValueError), (ups(1), outs(1), ValueError), (ups(5), outs(9), KeyError), (None, None, ValueError), (None, outs(4), KeyError)]:
        with pytest.raises(error):
            log.apply_changes(upserts, deletes)
    assert log.clock() == 1 and log.live().count() == 3
    done = log.apply_changes(ups(2, 5), outs(1))
    assert (done.ts, done.upserts, done.deletes) == (2, 2, 1)
    want = {t: sorted(map(tuple, log.live(t).collect())) for t in (1, 2)}
    log.compact(2)
    assert {t: sorted(map(tuple, log.live(t).collect())) for t in (1, 2)} == want
    assert len(log.files.names("data")) == 1 and log.clock() == 2
    log.files.write("note", "a")
    log.files.write("note", "b", replace=True)
    assert log.files.read("note") == "b" and log.files.names("_tmp") == []


def test_token_index(spark, tmp_path):
    index = TokenIndex(spark, f"file://{tmp_path}/tokens", 4)
    index.add(1, [E4[0], E4[1]])
    index.add(2, [E4[2]])
    t = index.add(3, [E4[3], [0, 0, 1, 1]])
    index.add(1, [E4[3]])  # fewer tokens than before
    assert index.tokens().groupBy("doc_id").count().orderBy("doc_id").collect() == [(1, 1), (2, 1), (3, 2)]
    assert [r.doc_id for r in index.search([E4[0], E4[1]], 1, t).collect()] == [1]
    assert [r.doc_id for r in index.search([E4[2]], 1).collect()] == [2]
    assert [r.doc_id for r in index.search([E4[2]], 1, encoder=multivector.Encoder(4, 2, 2)).collect()] == [2]
    assert index.delete(3) == 2 and index.tokens(t).count() == 5
    with pytest.raises(KeyError):
        index.delete(3)
    for bad in ([], [[1, 0]], [1, 0, 0, 0]):
        with pytest.raises(ValueError):
            index.add(4, bad)


def test_text_store(spark, tmp_path):
    memory = Memory(spark, f"file://{tmp_path}/mem", 2, "l2")
    store = TextStore(memory, lambda texts: [[float(len(t)), float(t.count("a"))] for t in texts])
    assert store.add_texts([]) == []
    first, second = store.add_texts(["aaa", "bb"], [{"k": 1}, {}])
    t = memory.snapshot()
    hit = store.similarity_search("aab", 1)[0]
    assert (hit.id, hit.text, hit.metadata, hit.similarity) == (first, "aaa", {"k": 1}, 0.0)
    branch = store.thread("talk")
    store.add_texts(["aab"], ids=["own"], branch=branch)
    assert store.thread("talk").name == branch.name
    assert [f.id for f in store.similarity_search("aab", 1, branch)] == ["own"] and len(store.similarity_search("aab")) == 2
    assert store.delete([second, "none"]) == 1 and [len(store.similarity_search("x", as_of=s)) for s in (None, t)] == [1, 2]
    for call in (lambda: store.add_texts(["a"], ids=[]), lambda: store.add_texts(["a"], [{}, {}]), lambda: store.similarity_search("a", branch=branch, as_of=t)):
        with pytest.raises(ValueError):
            call()
