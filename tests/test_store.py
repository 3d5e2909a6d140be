"""The log of versions: racing rebuilds, snapshots, what expires."""

import threading
import time

import pytest

from kinloom.plans import store


def table(spark, *ids):
    return {"skills": spark.createDataFrame([(i, f"n{i}", f"k{i}") for i in ids], "skill_id long, canonical_name string, match_key string"), "notes": spark.createDataFrame([(i,) for i in ids], "id long")}


def folders(path):
    return sorted(p.name for p in path.iterdir() if p.name.startswith("v-"))


def test_of_racing_rebuilds_one_wins(spark, tmp_path):
    path, results = f"file://{tmp_path}/s", []
    assert store.rebuild(spark, path, table(spark, 1)) == 1
    start = threading.Barrier(3)

    def go(i):
        start.wait()
        try:
            results.append((i, store.rebuild(spark, path, table(spark, i), base=1)))
        except store.ConcurrentRebuild:
            results.append((i, None))

    threads = [threading.Thread(target=go, args=(i,)) for i in (2, 3, 4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [i for i, v in results if v == 2]
    assert len(results) == 3 and len(won) == 1 and store.versions(spark, path) == [1, 2]
    assert [r[0] for r in store.current(spark, path, "notes").collect()] == won
    assert len(folders(tmp_path / "s")) == 2  # the others left nothing
    assert not [p for p in (tmp_path / "s/_log").iterdir() if "draft" in p.name]


def test_an_entry_is_put_once(spark, tmp_path):
    path = f"file://{tmp_path}/log/entry.json"
    assert store._put_if_absent(spark, path, "first") and not store._put_if_absent(spark, path, "second")
    assert (tmp_path / "log/entry.json").read_text() == "first"


def test_a_reader_holds_one_version(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store.rebuild(spark, path, table(spark, 1))
    held = store.snapshot(spark, path)
    first = held.table("skills")
    store.rebuild(spark, path, table(spark, 2, 3))
    assert first.count() == 1 and held.table("notes").count() == 1  # read after the commit, of the old version
    new = store.snapshot(spark, path)
    assert (held.version, new.version) == (1, 2) and {n: t.count() for n, t in new.tables().items()} == {"skills": 2, "notes": 2}
    assert store.snapshot(spark, path, 1).folder == held.folder
    with pytest.raises(KeyError):
        new.table("people")
    with pytest.raises(LookupError):
        store.snapshot(spark, path, 9)
    with pytest.raises(LookupError):
        store.snapshot(spark, f"file://{tmp_path}/none")


def test_broken_constraints_leave_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store.rebuild(spark, path, table(spark, 1))
    with pytest.raises(ValueError, match="constraints"):
        store.rebuild(spark, path, table(spark, 2, 2))
    assert store.versions(spark, path) == [1] and len(folders(tmp_path / "s")) == 1
    assert store.rebuild(spark, path, table(spark, 3)) == 2


def test_a_rebuild_from_an_old_version_fails(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    for i in (1, 2):
        store.rebuild(spark, path, table(spark, i))
    with pytest.raises(store.ConcurrentRebuild):
        store.rebuild(spark, path, table(spark, 5), base=1)
    assert [r[0] for r in store.current(spark, path, "notes").collect()] == [2]


def test_old_versions_expire(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    for i in (1, 2, 3):
        store.rebuild(spark, path, table(spark, i))
    orphan = tmp_path / "s/v-left-by-a-killed-rebuild"
    orphan.mkdir()
    assert store.expire(spark, path, keep=1) == [] and len(folders(tmp_path / "s")) == 4  # readers still have time
    time.sleep(1.1)
    assert store.expire(spark, path, keep=2, older_than=1) == [1]
    assert store.versions(spark, path) == [2, 3] and len(folders(tmp_path / "s")) == 2 and not orphan.exists()
    assert store.rebuild(spark, path, table(spark, 4)) == 4  # numbers are not used again
    with pytest.raises(ValueError, match="last"):
        store.expire(spark, path, keep=0)
