import pytest

from millrace.errors import MissingTable
from millrace.plans.history import History
from millrace.session import shared_folder
from millrace.streaming.accumulate import accumulate_stream


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def batch(spark, *items, schema="k int, v string, at int"):
    return spark.createDataFrame(list(items), schema)


@pytest.fixture(params=[1, 4])
def history(request, spark, tmp_path):
    return History(spark, str(tmp_path / "h"), keys=["k"], order_by="at DESC", buckets=request.param)


def test_first_batch_is_deduplicated_too(spark, history):
    history.merge(batch(spark, (1, "a", 1), (1, "b", 2), (2, "c", 1)))
    assert rows(history.read()) == [(1, "b", 2), (2, "c", 1)]


def test_latest_row_wins_whatever_the_order_of_batches(spark, history):
    history.merge(batch(spark, (1, "new", 9), (2, "x", 1), (None, "n", 1)))
    history.merge(batch(spark, (1, "old", 3), (2, "y", 2), (3, "z", 1), (None, "m", 2)))
    assert rows(history.read()) == rows(batch(spark, (1, "new", 9), (2, "y", 2), (3, "z", 1), (None, "m", 2)))


def test_new_columns_and_absent_columns(spark, history):
    history.merge(batch(spark, (1, "a", 1), (2, "b", 1)))
    history.merge(batch(spark, (2, 2, "extra"), (3, 1, "more"), schema="k int, at int, note string"))
    out = history.read()
    assert out.columns == ["k", "v", "at", "note"]
    assert rows(out) == [(1, "a", 1, None), (2, None, 2, "extra"), (3, None, 1, "more")]


def test_changed_type(spark, history):
    history.merge(batch(spark, *[(i, "a", 1) for i in range(20)]))
    history.merge(batch(spark, (1, "b", 2**40), schema="k int, v string, at bigint"))
    out = history.read()
    assert out.schema["at"].dataType.simpleString() == "bigint"
    assert out.count() == 20 and out.filter("k = 1").first()["at"] == 2**40


def test_a_batch_id_counts_once(spark, history):
    assert history.merge(batch(spark, (1, "a", 1)), batch_id="x-0") == 1
    assert history.merge(batch(spark, (1, "b", 2)), batch_id="x-1") == 2
    assert history.merge(batch(spark, (1, "z", 99)), batch_id="x-0") == 1
    assert rows(history.read()) == [(1, "b", 2)]


def test_older_versions_stay(spark, history):
    history.merge(batch(spark, (1, "a", 1)))
    history.merge(batch(spark, (1, "b", 2)))
    assert rows(history.read(version=1)) == [(1, "a", 1)]
    with pytest.raises(MissingTable):
        history.read(version=7)


def test_an_unfinished_write_is_not_seen(spark, history):
    history.merge(batch(spark, (1, "a", 1)))
    # Data of the next version was written, and a commit begun, when the writer died.
    batch(spark, (1, "lost", 5)).write.parquet(f"{history.path}/data/v=2/b=0")
    batch(spark, (1, "lost", 5)).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false"
    ).parquet(f"{history.path}/commits/0000000002")
    assert rows(history.read()) == [(1, "a", 1)]
    history.merge(batch(spark, (2, "b", 1)))
    assert rows(history.read()) == [(1, "a", 1), (2, "b", 1)]


def test_empty_first_batch(spark, history):
    history.merge(batch(spark))
    assert history.read().columns == ["k", "v", "at"] and history.read().count() == 0
    history.merge(batch(spark, (1, "a", 1)))
    assert rows(history.read()) == [(1, "a", 1)]


def test_no_history(spark, tmp_path):
    with pytest.raises(MissingTable):
        History(spark, str(tmp_path / "none"), ["k"], "at").read()


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    history = History(spark, str(tmp_path / "h"), keys=["k"], order_by="at DESC", buckets=16)
    history.merge(batch(spark, *[(i, "a", 1) for i in range(200)]))
    history.merge(batch(spark, (5, "b", 2)))
    versions = history.state().data_versions
    assert sorted(versions.values()).count(2) == 1 and len(versions) == 16
    assert history.read().count() == 200


@pytest.mark.parametrize("keys, buckets", [(["k"], 8), (["k"], 1), (["v"], 16), (["v"], 1)])
def test_a_new_layout_rewrites_the_table(spark, tmp_path, keys, buckets):
    first = History(spark, str(tmp_path / "h"), keys=["k"], order_by="at DESC", buckets=16)
    first.merge(batch(spark, *[(i, f"v{i % 5}", i) for i in range(50)]))
    second = History(spark, first.path, keys=keys, order_by="at DESC", buckets=buckets)
    second.merge(batch(spark, (100, "v0", 100)))
    assert second.state().buckets == buckets
    assert second.read().count() == (51 if keys == ["k"] else 5)
    second.merge(batch(spark, (101, "v1", 101)))
    assert second.read().count() == (52 if keys == ["k"] else 5)


def test_buckets_grow_with_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("millrace.plans.history.BUCKET_BYTES", 4_000)
    history = History(spark, str(tmp_path / "h"), keys=["k"], order_by="at DESC")
    counts = []
    for start in (0, 400, 800):
        history.merge(spark.range(start, start + 400).selectExpr("id AS k", "uuid() AS v", "1 AS at"))
        counts.append(history.state().buckets)
        assert history.read().count() == start + 400
    assert counts[0] == 1 and counts[0] < counts[1] < counts[2]


def test_prune(spark, tmp_path):
    history = History(spark, str(tmp_path / "h"), keys=["k"], order_by="at DESC", buckets=4)
    history.merge(batch(spark, *[(i, "a", 1) for i in range(20)]))
    for at in (2, 3, 4):
        history.merge(batch(spark, (1, "b", at)))
    assert history.prune(keep=2) == [1, 2]
    assert [c.version for c in history.commits()] == [3, 4]
    assert history.read().count() == 20 and history.read(3).filter("k = 1").first()["at"] == 3
    with pytest.raises(MissingTable):
        history.read(1)


def test_hot_key(spark, history):
    big = spark.range(0, 20_000, 1, 8).selectExpr("CAST(if(id % 3 = 0, 1, id) AS INT) AS k", "'v' AS v", "CAST(id AS INT) AS at")
    history.merge(big)
    assert history.read().count() == big.select("k").distinct().count()
    assert history.read().filter("k = 1").first()["at"] == 19_998


# -- streaming -----------------------------------------------------------------------


def test_stream_in_pieces_equals_one_batch(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")
    source = str(tmp_path / "arriving")
    history = History(spark, str(tmp_path / "h"), keys=["user_id"], order_by="ts DESC, event_id DESC", buckets=4)

    def arrive():
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source)
        accumulate_stream(stream, history, "pieces", str(tmp_path / "cp")).awaitTermination()

    events.filter("event_id % 2 = 1").repartition(3).write.mode("append").parquet(source)
    arrive()
    events.filter("event_id % 2 = 0").repartition(3).write.mode("append").parquet(source)
    arrive()
    versions = len(history.commits())
    arrive()
    assert len(history.commits()) == versions == 4

    whole = History(spark, str(tmp_path / "w"), keys=["user_id"], order_by="ts DESC, event_id DESC")
    whole.merge(events)
    assert rows(history.read()) == rows(whole.read())


def test_stream_drops_repeated_events(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id")
    source = str(tmp_path / "arriving")
    events.unionAll(events).write.parquet(source)
    history = History(spark, str(tmp_path / "h"), keys=["event_id"], order_by="ts")
    stream = spark.readStream.schema(events.schema).parquet(source)
    accumulate_stream(
        stream, history, "repeats", str(tmp_path / "cp"), event_time="ts", delay="40 days", distinct_on=["event_id"]
    ).awaitTermination()
    assert history.read().count() == events.count()
    with pytest.raises(ValueError):
        accumulate_stream(stream, history, "x", str(tmp_path / "cp2"), distinct_on=["event_id"])


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
