"""Streams over folders, and the selection operators that a watcher uses."""

import json

import pytest
from pyspark.sql import functions as F

from lyrebird.operators import runs, sampling
from lyrebird.streaming import watch


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_watch_handles_each_file_once(spark, tmp_path):
    inbox, target = tmp_path / "in", tmp_path / "out"
    handle = watch.upsert(str(target), "step")
    run = lambda: watch.watch_json(
        spark, str(inbox), "step long, loss double", handle, str(tmp_path / "state"),
    ).awaitTermination()
    write(inbox, "a.json", [{"step": 1, "loss": 0.5}, {"step": 2, "loss": 0.4}])
    run()
    write(inbox, "b.json", [{"step": 2, "loss": 0.3}, {"step": 3, "loss": 0.2}])
    run()
    run()
    got = lambda: {
        (r.step, r.loss) for r in watch.latest(spark, str(target)).select("step", "loss").collect()
    }
    assert got() == {(1, 0.5), (2, 0.3), (3, 0.2)}
    # A batch that was cut off leaves no version; when it comes again it starts from the last complete one.
    newest = max(target.glob("version=*"), key=lambda p: int(p.name.partition("=")[2]))
    number = int(newest.name.partition("=")[2])
    (newest / "_SUCCESS").unlink()
    assert got() == {(1, 0.5), (2, 0.4)}
    handle(spark.createDataFrame([(2, 0.3), (3, 0.2)], "step long, loss double"), number)
    assert got() == {(1, 0.5), (2, 0.3), (3, 0.2)} and watch.latest(spark, str(tmp_path / "none")) is None


def test_batches_carry_over_micro_batches(spark, tmp_path):
    inbox = tmp_path / "in"
    write(inbox, "a.json", [{"k": "x", "i": 0, "f": 8, "t": 3}, {"k": "x", "i": 1, "f": 5, "t": 2}])
    rows = spark.readStream.schema("k string, i long, f long, t long").json(str(inbox))
    out = watch.batch_stream(rows, "k", "i", "f", "t", 18, 10)

    def run():
        out.writeStream.format("json").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "state"),
        ).trigger(availableNow=True).start().awaitTermination()

    run()
    write(inbox, "b.json", [{"k": "x", "i": 2, "f": 3, "t": 1}])
    run()
    got = {(r.i, r.batch) for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert got == {(0, 0), (1, 1), (2, 1)}


def test_pending_and_retained(spark):
    files = spark.createDataFrame(
        [("a", 1, 10.0), ("b", 2, 20.0), ("c", 3, 99.0), ("d", 4, 30.0)], "path string, step long, modified double",
    )
    done = spark.createDataFrame([("a",)], "path string")
    ask = lambda **k: [
        r.path for r in runs.pending(files, done, "path", "modified", 5, F.lit(100.0), **k).collect()
    ]
    assert sorted(ask()) == ["b", "d"] and ask(newest_only=True) == ["d"]
    records = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "path string, dir string")
    kept = spark.createDataFrame([("a", None), (None, "y"), ("q", "x")], "path string, dir string")
    assert sorted(r.path for r in runs.retained(records, kept, "path", "dir").collect()) == ["a", "b"]
    assert [r.path for r in runs.prune(records, done, "path").orderBy("path").collect()] == ["b", "c"]


def test_choices(spark):
    a, b = spark.createDataFrame(
        [(0, "r"), (1, "s")], "i int, x string",
    ), spark.createDataFrame([(0, "u"), (1, "v")], "i int, y string")
    assert sorted(map(tuple, sampling.zip_rows(a, b, "i").collect())) == [(0, "r", "u"), (1, "s", "v")]
    with pytest.raises(Exception, match="differ in length"):
        sampling.zip_rows(a, b.limit(1), "i").collect()
    assert runs.merge_config({"a": 1, "b": 2}, {"a": None, "b": 3}) == {"a": 1, "b": 3}
    assert runs.resolve_max_steps(None, 3, 7) == 21 and runs.resolve_max_steps(None, None, None) == 100
    with pytest.raises(ValueError):
        runs.resolve_max_steps(1, 1, 1)
    e = spark.createDataFrame(
        [(1, 0.9, 0.5), (2, 0.8, float("nan")), (3, 0.7, 0.5), (4, 0.6, 0.4)], "epoch int, train double, eval double",
    )
    assert [
        r.is_best for r in runs.best_epoch(e, "epoch", "train", "eval").orderBy("epoch").collect()
    ] == [True, True, False, True]
