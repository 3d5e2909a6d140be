"""Intermediates belong to the run that wrote them."""

import threading

from kinloom.shared import bucketed, fresh_path, scratch, written


def exists(spark, path):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def test_threads_do_not_delete_each_others_files(spark):
    opened, closed, found, errors = threading.Event(), threading.Event(), {}, []

    def slow():
        try:
            with scratch(spark):
                opened.wait(30)  # the other run is open now
                df = written(spark.range(5), "slow")
                found["path"] = df.inputFiles()[0]
                closed.wait(60)
                found["rows"] = df.count()
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    t = threading.Thread(target=slow)
    t.start()
    with scratch(spark):
        opened.set()
        written(spark.range(3), "fast").count()
        while "path" not in found and not errors:
            t.join(0.05)
    closed.set()
    t.join()
    assert not errors and found["rows"] == 5
    assert not exists(spark, found["path"])


def test_results_outlive_the_scratch_that_made_them(spark):
    with scratch(spark):
        with scratch(spark):
            kept = fresh_path(spark, "kept", keep=True)
            lost = fresh_path(spark, "lost")
            spark.range(2).write.parquet(kept)
            spark.range(2).write.parquet(lost)
        assert exists(spark, kept) and not exists(spark, lost)
    assert not exists(spark, kept)


def test_an_error_leaves_files_for_a_look(spark):
    try:
        with scratch(spark):
            path = fresh_path(spark, "odd")
            spark.range(1).write.parquet(path)
            raise KeyError
    except KeyError:
        assert exists(spark, path)


def test_buckets_are_joined_without_moving_them(spark):
    with scratch(spark), bucketed(spark.range(100).selectExpr("id % 10 AS k", "id AS v"), ["k"], "b") as t:
        other = spark.range(5).withColumnRenamed("id", "k")
        plan = t.join(other.hint("merge"), "k")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        assert t.join(other, "k").count() == 50
    assert not [x for x in spark.catalog.listTables() if x.name.startswith("kinloom_")]
