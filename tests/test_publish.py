"""Versions appear whole: writers that die between writes leave what was there before."""

import threading

import pytest
from pyspark.errors import StreamingQueryException

from ebbtide.operators import train
from ebbtide.schema import ID, RAW_SCHEMA
from ebbtide.sources import models as store
from ebbtide.sources import publish
from ebbtide.sources.staging import new_path
from ebbtide.streaming import scoring

TINY = train.Settings(trees=5, forest_depth=3, iterations=3, max_iter=30)


@pytest.fixture(scope="module")
def models(ready):
    rows = ready.vectors("train")
    return store.ModelSet(ready.features, train.logistic_regression(rows.count(), TINY).fit(rows))


def test_numbers_and_latest(spark):
    root = new_path(spark, "root")
    assert publish.commits(spark, root) == [] and publish.latest(spark, root) is None
    for i in range(3):
        assert publish.commit(spark, root, {"v": f"é{i}"}).number == i
    assert publish.latest(spark, root).content == {"v": "é2"} and publish.latest(spark, root, 1).content == {"v": "é1"}
    assert publish.commit(spark, root, {"v": "again"}, 1) is None and publish.latest(spark, root, 1).content == {"v": "é1"}


def test_a_commit_that_was_cut_off_counts_as_none(spark):
    root = new_path(spark, "root")
    publish.commit(spark, root, {"v": 0})
    assert publish._create(spark, f"{root}/_commits/{1:012d}.json", '{"v": ')
    assert [c.number for c in publish.commits(spark, root)] == [0]
    assert publish.commit(spark, root, {"v": 1}, 1).number == 1  # its own writer comes back
    assert publish._create(spark, f"{root}/_commits/{2:012d}.json", "")
    assert publish.commit(spark, root, {"v": 3}).number == 3     # another writer goes on behind it
    assert [c.content["v"] for c in publish.commits(spark, root)] == [0, 1, 3]


def test_writers_at_the_same_time_get_numbers_of_their_own(spark):
    root, done = new_path(spark, "root"), []
    threads = [threading.Thread(target=lambda i=i: done.append(publish.commit(spark, root, {"v": i}).number)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(done) == list(range(8)) and len(publish.commits(spark, root)) == 8


def test_a_model_set_is_never_half_written(spark, models, monkeypatch):
    path = new_path(spark, "set")
    assert store.save_models(models, path, spark) == 0
    names, save = models.feature_names, store.PipelineModel
    with monkeypatch.context() as m:
        def dies(parts):
            if parts[0] is models.classifier:
                raise OSError("killed between two parts")
            return save(parts)

        dies.load = save.load
        m.setattr(store, "PipelineModel", dies)
        with pytest.raises(OSError):
            store.save_models(models, path, spark)
        assert store.load_models(path, spark).feature_names == names
    with monkeypatch.context() as m:
        m.setattr(store, "commit", lambda *_: (_ for _ in ()).throw(OSError("killed before the commit")))
        with pytest.raises(OSError):
            store.save_models(models, path, spark)
    assert [c.number for c in publish.commits(spark, path)] == [0]
    assert store.save_models(models, path, spark) == 1
    assert store.load_models(path, spark, 0).feature_names == store.load_models(path, spark).feature_names == names
    with pytest.raises(FileNotFoundError):
        store.load_models(path, spark, 7)


def test_a_damaged_optional_part_is_an_error(spark, models):
    path = new_path(spark, "set")
    store.save_models(store.ModelSet(models.features, models.classifier, [models.classifier]), path, spark)
    folder = publish.latest(spark, path).content["folder"]
    spark.createDataFrame([("not a model",)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/voter0/metadata")
    with pytest.raises(Exception):
        store.load_models(path, spark)


@pytest.mark.parametrize("fails_at", ["second folder", "commit"])
def test_a_batch_appears_whole_and_once(spark, customers, models, monkeypatch, fails_at):
    source, target = new_path(spark, "in"), new_path(spark, "out")
    customers.repartition(4).write.parquet(source)

    def run():
        scoring.score_stream(spark, source, RAW_SCHEMA, models, target, f"{target}/checkpoint", files_per_batch=2).awaitTermination()

    calls = {"n": 0}
    with monkeypatch.context() as m:
        if fails_at == "commit":
            def commit(*args):
                calls["n"] += 1
                if calls["n"] == 2:
                    raise OSError("killed before the commit")
                return publish.commit(*args)

            m.setattr(scoring, "commit", commit)
        else:
            def folder(root, part):
                calls["n"] += 1
                return "/proc/no/such/folder/attempt-x" if calls["n"] == 4 else publish.new_folder(root, part)

            m.setattr(scoring, "new_folder", folder)
        with pytest.raises(StreamingQueryException):
            run()
    first = scoring.read_results(spark, target, "scored").count() + scoring.read_results(spark, target, "rejected").count()
    assert 0 < first < customers.count() and [c.number for c in publish.commits(spark, target)] == [0]
    run()
    scored, refused = scoring.score_requests(customers, models)
    got = scoring.read_results(spark, target, "scored")
    assert got.count() == scored.count() and got.select(ID).distinct().count() == got.count()
    assert scoring.read_results(spark, target, "rejected").count() == refused.count()
    assert [c.number for c in publish.commits(spark, target)] == [0, 1]


def test_nothing_is_there_before_the_first_commit(spark):
    assert scoring.read_results(spark, new_path(spark, "none"), "scored") is None
