"""Incremental refresh that breaks off and repeats; streams with state against their batch forms."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docloom.operators import shared, store
from docloom.streaming import limits, stateful
from docloom.streaming.refresh import Refresh

STAGED = "source_url string, text string, at long"


def lengths(chunks):
    return chunks.withColumn("vector", F.array(F.length("content").cast("float"), F.lit(1.0).cast("float")))


def now(spark, refresh):
    docs = sorted((r.source_url, r.text) for r in refresh.table(spark, "documents").collect())
    chunks = sorted((r.source_url, r.content, r.is_active) for r in refresh.table(spark, "chunks").collect())
    vectors = sorted((r.source_url, r.vector[0]) for r in refresh.table(spark, "embedded").collect())
    return docs, chunks, vectors


BATCHES = [
    [("a", "one\ntwo", 1), ("b", "three", 1), ("c", "x\n\ny", 1)],
    [("a", "one\ntwo", 2), ("b", "three\nfour", 2), ("d", None, 2), (None, "lost", 2)],
    [("b", "four", 3), ("b", "old", 2), ("c", "y", 3)],
]
FINAL = (
    [("a", "one\ntwo"), ("b", "four"), ("c", "y"), ("d", "")],
    [("a", "one", True), ("a", "two", True), ("b", "four", False), ("b", "four", True), ("b", "three", False), ("c", "x", False), ("c", "y", False), ("c", "y", True)],
    [("a", 3.0), ("a", 3.0), ("b", 4.0), ("c", 1.0)],
)


def test_batches_and_repeats(spark):
    refresh = Refresh(shared.temporary(spark, "refresh"), lengths, buckets=4)
    for i, rows in enumerate(BATCHES):
        refresh.apply(spark.createDataFrame(rows, STAGED), i)
    docs, chunks, vectors = now(spark, refresh)
    assert (docs, chunks, vectors) == FINAL
    assert [(r.batch, r.new, r.updated, r.unchanged) for r in refresh.ledger(spark)] == [(0, 3, 0, 0), (1, 1, 1, 1), (2, 0, 2, 0)]
    for i, rows in enumerate(BATCHES):
        refresh.apply(spark.createDataFrame(rows + [("z", "never", 9)], STAGED), i)
    assert now(spark, refresh) == FINAL


@pytest.mark.parametrize("broken", ["embed", "ledger"])
def test_a_batch_that_breaks_off_is_done_again(spark, tmp_path, monkeypatch, broken):
    """The stream dies in its second batch, before anything or with all written but the ledger; a new one goes on."""
    folder, path = tmp_path / "staged", shared.temporary(spark, "refresh")
    died = []

    def embed(chunks):
        if broken == "embed" and len(refresh.ledger(spark)) == 1 and not died:
            died.append(1)
            raise RuntimeError("lost")
        return lengths(chunks)

    refresh = Refresh(path, embed, buckets=4)
    fill = Refresh._fill

    def die(self, spark_, name, batch_id, touched, rows):
        fill(self, spark_, name, batch_id, touched, rows)
        if broken == "ledger" and name == "embedded" and batch_id == 1 and not died:
            died.append(1)
            raise RuntimeError("lost")

    monkeypatch.setattr(Refresh, "_fill", die)
    stream = lambda: spark.readStream.schema(STAGED).option("maxFilesPerTrigger", 1).parquet(str(folder))
    for i, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, STAGED).coalesce(1).write.mode("append").parquet(str(folder))
        query = refresh.start(stream(), str(tmp_path / "checkpoint"))
        try:
            query.awaitTermination(120)
        except Exception:
            assert i == 1
            assert len(refresh.ledger(spark)) == 1
            refresh.start(stream(), str(tmp_path / "checkpoint")).awaitTermination(120)
    assert died and now(spark, refresh) == FINAL and len(refresh.ledger(spark)) == 3


# --- state -------------------------------------------------------------------


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


START = datetime(2024, 1, 1)


def run(spark, tmp_path, parts, schema, build, name, mode):
    """The rows of a stream that gets `parts` one after another, restarted from its checkpoint between them."""
    folder = tmp_path / "in"
    out = []
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        query = build(rows).writeStream.foreachBatch(lambda df, i: out.extend(df.collect())).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    return out


def test_limits_in_event_time(spark, tmp_path, rocks):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), START + timedelta(seconds=i * 2 + rng.randint(0, 1)), i) for i in range(90)]
    shuffled = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 8))  # at most some 20 seconds late
    far = [("end", START + timedelta(hours=2), 1000)]
    schema = "key string, at timestamp, id long"
    got = run(spark, tmp_path, [shuffled[:30], shuffled[30:60], shuffled[60:], far, [("end", START + timedelta(hours=4), 1001)]], schema, lambda s: stateful.limited(s, 30.0, 4, "60 seconds"), "limits", "append")
    batch = limits.limited_batch(spark.createDataFrame(rows, schema), 30.0, 4).collect()
    mine = sorted((r.key, r.at, r.id, r.admitted) for r in got if r.key != "end")
    assert mine == sorted((r.key, r.at, r.id, r.admitted) for r in batch)
    assert {r.admitted for r in got} == {True, False}


def test_sessions_in_any_order(spark, tmp_path, rocks):
    rng = random.Random(6)
    rows = [(f"s{i % 5}", i // 5, f"m{i % 3}", START + timedelta(seconds=i)) for i in range(60)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    schema = "session_id string, turn long, mode string, at timestamp"
    end = [("end", 0, "m", START + timedelta(hours=1))]
    got = run(spark, tmp_path, [shuffled[:20], shuffled[20:], end, [("end", 1, "m", START + timedelta(hours=3))]], schema, lambda s: stateful.sessions(s, 600, "300 seconds"), "sessions", "update")
    last = {}
    for r in got:
        last[r.session_id] = r
    batch = store.sessions(spark.createDataFrame(rows, schema), "session_id", "turn", "mode", "at").collect()
    assert {(r.session_id, r.turn_count, r.mode, r.created_at, r.last_active_at) for r in batch} == {tuple(last[s])[:5] for s in last if s != "end"}
    assert not any(last[r.session_id].active for r in batch)


def test_the_state_store_is_checked(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        stateful.sessions(spark.createDataFrame([], "session_id string, turn long, mode string, at timestamp"), 1, "1 second")


def test_contents_are_written_aside_once_and_lost_vectors_are_made_later(spark, monkeypatch):
    """A batch keeps whole texts aside only as staged; vectors that `embed` did not give come with the next batch of their bucket."""
    from docloom.streaming import refresh as module

    aside = []
    monkeypatch.setattr(module, "written", lambda df, name="table": aside.append((name, df.columns)) or shared.written(df, name))
    lost = []
    refresh = Refresh(shared.temporary(spark, "refresh"), lambda rows: lengths(rows if lost else rows.where("content != 'b2'")), buckets=1)
    refresh.apply(spark.createDataFrame([("a", "a1\na2", 0), ("b", "b1\nb2", 0)], STAGED), 0)
    lost.append(1)
    refresh.apply(spark.createDataFrame([("a", "a1\na3", 1), ("b", "b1\nb2", 1)], STAGED), 1)
    assert [name for name, columns in aside if {"text", "content"} & set(columns)] == ["staged", "staged"]
    assert [(r.embedded, r.removed) for r in refresh.ledger(spark)] == [(4, 0), (2, 1)]
    chunks = {(r.content, r.is_active) for r in refresh.table(spark, "chunks").collect()}
    assert chunks == {("a1", True), ("a2", False), ("a3", True), ("b1", True), ("b2", True)}
    assert refresh.table(spark, "embedded").count() == 4
