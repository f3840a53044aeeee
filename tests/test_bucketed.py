"""Bucketed tables: what an upsert writes and an append reads, rivals, damage, replays."""

import pytest

from acrescope.sources import bucketed, versions


def table(spark, rows):
    return spark.createDataFrame(rows, "k int, v int")


def content(spark, path, version=None):
    return {r.k: r.v for r in bucketed.read(spark, path, version).collect()}


def files(tmp_path):
    return {str(p) for p in (tmp_path / "t" / "data").rglob("*.parquet")}


def test_a_one_row_upsert_rewrites_one_bucket(spark, tmp_path):
    path = str(tmp_path / "t")
    first = bucketed.upsert(table(spark, [(k, k) for k in range(200)]), path, ["k"], ["v"], buckets=8)
    before = files(tmp_path)
    assert len(before) == len(first.data) == 8
    after = bucketed.upsert(table(spark, [(5, 99)]), path, ["k"], ["v"])
    new = files(tmp_path) - before
    changed = [b for b in after.data if after.data[b] != first.data[b]]
    assert len(new) == len(changed) == 1 and f"_bucket={changed[0]}" in new.pop()
    assert content(spark, path) == {**{k: k for k in range(200)}, 5: 99}
    assert content(spark, path, 1) == {k: k for k in range(200)}  # the old version stays readable


def test_upsert_keeps_the_last_per_key_of_a_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    bucketed.upsert(table(spark, [(1, 10), (2, 20)]), path, ["k"], ["v"])
    bucketed.upsert(table(spark, [(2, 5), (2, 6), (3, 30)]), path, ["k"], ["v"])
    assert content(spark, path) == {1: 10, 2: 6, 3: 30}
    assert bucketed.upsert(table(spark, []), path, ["k"], ["v"]).version == 2  # nothing to publish
    with pytest.raises(ValueError):
        bucketed.upsert(table(spark, [(1, 1)]), path, ["v"], ["k"])
    with pytest.raises(FileNotFoundError):
        bucketed.read(spark, str(tmp_path / "none"))


def test_no_update_of_a_rival_is_hidden(spark, tmp_path, monkeypatch):
    path, publish, calls = str(tmp_path / "t"), versions.publish, []
    bucketed.upsert(table(spark, [(1, 10), (2, 20)]), path, ["k"], ["v"], buckets=1)

    def slow(session, root, version, document):
        calls.append(version)
        if len(calls) == 1:  # between our merge and our publication another writer comes
            bucketed.upsert(table(spark, [(2, 21), (3, 31)]), path, ["k"], ["v"])
        publish(session, root, version, document)

    monkeypatch.setattr(versions, "publish", slow)
    bucketed.upsert(table(spark, [(1, 12)]), path, ["k"], ["v"])
    assert content(spark, path) == {1: 12, 2: 21, 3: 31} and calls == [2, 2, 3]


def test_a_version_is_published_once(spark, tmp_path):
    root = str(tmp_path / "v")
    versions.publish(spark, root, 1, {"a": 1})
    with pytest.raises(versions.VersionTaken):
        versions.publish(spark, root, 1, {"a": 2})
    assert versions.latest(spark, root) == (1, {"a": 1}) and versions.latest(spark, str(tmp_path / "w")) is None


def test_a_damaged_version_is_an_error_and_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    bucketed.upsert(table(spark, [(1, 10)]), path, ["k"], ["v"])
    bucketed.upsert(table(spark, [(1, 11)]), path, ["k"], ["v"])
    newest = sorted((tmp_path / "t" / "versions").glob("v*.json"))[-1]
    (tmp_path / "t" / "versions" / f".{newest.name}.crc").unlink(missing_ok=True)
    newest.write_text("{")
    with pytest.raises(ValueError, match="damaged"):
        versions.latest(spark, f"{path}/versions", wait=0)
    assert content(spark, path, 1) == {1: 10}


def test_a_failed_job_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    bucketed.upsert(table(spark, [(1, 10)]), path, ["k"], ["v"])
    monkeypatch.setattr(bucketed, "_filters", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        bucketed.upsert(table(spark, [(1, 11)]), path, ["k"], ["v"])
    assert content(spark, path) == {1: 10}


def test_appends_read_only_files_that_may_hold_a_key(spark, tmp_path):
    path = str(tmp_path / "t")
    for batch in range(3):
        bucketed.append_new(table(spark, [(k, batch) for k in range(100 * batch, 100 * batch + 100)]), path, ["k"], "a", batch, buckets=4)
    state = bucketed.current(spark, path)
    assert {len(f) for f in state.data.values()} == {3}
    assert bucketed.may_hold(spark, path, state, table(spark, [(k, 0) for k in range(1000, 1400)])) == set()  # new keys: no file is read
    (pair,) = bucketed.may_hold(spark, path, state, table(spark, [(150, 0), (5000, 0)]))
    read = bucketed._read_buckets(spark, path, state, [pair[0]], {pair})
    assert all(f"{pair[1]}/_bucket={pair[0]}/" in f for f in read.inputFiles()) and 150 in {r.k for r in read.collect()}


def test_replays_add_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = table(spark, [(k, k % 7) for k in range(50)] * 2 + [(3, 0)])
    one = bucketed.append_new(rows, path, ["k"], "a", 0)
    assert bucketed.append_new(rows, path, ["k"], "a", 0).version == one.version  # known by its number
    two = bucketed.append_new(rows, path, ["k"], "b", 0)  # known by its keys
    assert two.version == one.version + 1 and two.data == one.data
    bucketed.append_new(table(spark, [(49, 1), (50, 1)]), path, ["k"], "b", 1)
    assert content(spark, path) == {**{k: k % 7 for k in range(50)}, 3: 0, 50: 1} and bucketed.read(spark, path).count() == 51
    assert bucketed.append_new(table(spark, []), path, ["k"], "b", 2).data == bucketed.current(spark, path).data


def test_upserts_appends_and_compaction_share_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    for batch in range(4):
        bucketed.append_new(table(spark, [(k, batch) for k in range(10 * batch, 10 * batch + 20)]), path, ["k"], "a", batch, buckets=2)
    bucketed.upsert(table(spark, [(7, 70), (900, 9)]), path, ["k"], ["v"])
    want = content(spark, path)
    assert want[7] == 70 and want[15] == 0 and want[25] == 1 and len(want) == 51
    state = bucketed.compact(spark, path, at_most=1)
    assert {len(f) for f in state.data.values()} == {1} and content(spark, path) == want
    bucketed.append_new(table(spark, [(7, 1), (900, 1), (15, 1), (901, 1)]), path, ["k"], "a", 9)
    assert content(spark, path) == {**want, 901: 1}
