"""The log of a store."""

import multiprocessing
import os

import pytest

from rasterloom.sources import files, log, store


def held(folder):
    return sorted(n for n in os.listdir(folder) if not n.startswith("."))


def commit_many(path, names, n):
    done = 0
    for k in range(n):
        for name in names:
            w = log.Writer(path, name)
            try:
                w.commit(level={"level": k, "by": os.getpid()})
                done += 1
            except log.Conflict:
                pass
    return done


def test_states_follow_each_other(tmp_path):
    path = str(tmp_path)
    assert store.image_rows(path, "a") == (None, [])
    w = log.Writer(path, "a")
    w.commit(level={"level": 1, "x": 1})
    w.commit(level={"level": 0, "x": 2})
    w.commit(image={"image_id": "a", "valid": True})
    w.commit(level={"level": 1, "x": 3})
    assert store.image_rows(path, "a") == ({"image_id": "a", "valid": True}, [{"level": 0, "x": 2}, {"level": 1, "x": 3}])
    assert log.Writer(path, "a").state == w.state and store.image_rows(path, "b") == (None, [])


def test_of_two_writers_of_one_image_one_fails(tmp_path):
    one, two = (log.Writer(str(tmp_path), "a") for _ in range(2))
    one.commit(level={"level": 0})
    with pytest.raises(log.Conflict, match="image 'a'"):
        two.commit(level={"level": 0})
    one.commit(image={"valid": True})
    late = log.Writer(str(tmp_path), "a")
    late.commit(level={"level": 0})
    with pytest.raises(log.Conflict):
        one.commit(level={"level": 5})


def test_writers_of_other_images_of_a_folder_take_the_next_number(tmp_path, monkeypatch):
    monkeypatch.setattr(log, "BUCKETS", 1)
    writers = [log.Writer(str(tmp_path), f"i{k}") for k in range(5)]
    for level in range(3):
        for w in writers:
            w.commit(level={"level": level})
    assert all(sorted(log.Writer(str(tmp_path), w.image_id).levels) == [0, 1, 2] for w in writers)


def test_many_processes_lose_nothing(tmp_path, monkeypatch):
    monkeypatch.setattr(log, "BUCKETS", 1)
    monkeypatch.setattr(log, "ERA", 7)
    path = str(tmp_path)
    names = [[f"own{k}", "shared"] for k in range(5)]
    with multiprocessing.get_context("fork").Pool(5) as pool:
        done = pool.starmap(commit_many, [(path, n, 12) for n in names])
    folder = log.bucket_of(path, "x")
    found, last = log.states(folder)
    assert last == sum(done) and all(sorted(log.Writer(path, n[0]).levels) == list(range(12)) for n in names)
    assert set(found) == {n for pair in names for n in pair}


def test_opening_reads_a_bounded_number_of_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log, "BUCKETS", 4)
    path = str(tmp_path)
    writers = {f"image {k}": log.Writer(path, f"image {k}") for k in range(300)}
    level = {"image_id": "", "level": 0, "axes": "YX", "shape": [3, 4], "dtype": "uint8", "tile": [3, 4], "codec": "zstd", "pixel_depth": 1, "original_axes": "YX", "original_shape": [3, 4], "properties": {"a": "b"}, "load_id": "x"}
    for name, w in writers.items():
        w.commit(level=level | {"image_id": name})
        w.commit(image={"image_id": name, "fmt_version": 2, "axes": "YX", "channels": ["c"], "metadata": "{}", "original_metadata": None, "valid": True})
    read = []
    plain = files.read_range
    monkeypatch.setattr(files, "read_range", lambda uri, *a: read.append(uri) or plain(uri, *a))
    for name in ("image 0", "image 150", "image 299"):
        read.clear()
        image, levels = store.image_rows(path, name)
        assert image["image_id"] == levels[0]["image_id"] == name and len(read) <= log.ERA + 1
    log.trim(path)
    assert all(len(held(f"{path}/log/{d}")) == 1 for d in os.listdir(f"{path}/log"))
    # the tables over all images come from the same files
    assert store.images(spark, path).filter("valid and channels[0] = 'c'").count() == 300
    rows = store.levels(spark, path).collect()
    assert len(rows) == 300 and {(tuple(r.shape), r.properties["a"]) for r in rows} == {((3, 4), "b")}


def test_a_late_writer_takes_no_number_again(tmp_path, monkeypatch):
    monkeypatch.setattr(log, "BUCKETS", 1)
    late, other = log.Writer(str(tmp_path), "late"), log.Writer(str(tmp_path), "other")
    for k in range(3 * log.ERA):
        other.commit(level={"level": k})
    late.commit(level={"level": 7})
    found, last = log.states(late.folder)
    assert last == 3 * log.ERA + 1 == late.last and found["late"]["levels"] == [{"level": 7}] and len(found["other"]["levels"]) == 3 * log.ERA
    # a snapshot that was not written leaves the one before in use
    os.unlink(log.snapshot_name(late.folder, 3))
    assert log.states(late.folder) == (found, last)
    log.snapshot(late.folder, 3)
    assert log.states(late.folder) == (found, last) and log.listed(late.folder)[0] == 3


def test_files_are_created_once_on_other_stores_too(tmp_path, monkeypatch):
    from pyarrow import fs

    monkeypatch.setattr(files, "store_of", lambda uri: (fs.SubTreeFileSystem("/", fs.LocalFileSystem()), uri.lstrip("/")))
    assert log.created(f"{tmp_path}/a/1.json", b"one") and not log.created(f"{tmp_path}/a/1.json", b"two")
    assert held(tmp_path / "a") == ["1.json"] and (tmp_path / "a" / "1.json").read_bytes() == b"one"
