"""Files put in place in one step, and hashes of files."""

import hashlib
import os

import pytest

from quern.sources import shared


def test_a_file_is_replaced_in_one_step(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/deep/state.json"
    assert shared.read_json(spark, at) is None
    shared.write_json(spark, {"n": 1}, at)
    shared.write_json(spark, {"n": 2}, at)
    assert shared.read_json(spark, at) == {"n": 2}
    assert [f for f in os.listdir(tmp_path / "deep") if not f.startswith(".")] == ["state.json"]
    # A stop before the last step leaves the old file, and no other.
    monkeypatch.setattr(shared, "replace", lambda *a: (_ for _ in ()).throw(RuntimeError("stop")))
    with pytest.raises(RuntimeError):
        shared.write_json(spark, {"n": 3}, at)
    assert shared.read_json(spark, at) == {"n": 2}
    assert [f for f in os.listdir(tmp_path / "deep") if not f.startswith(".")] == ["state.json"]


def test_folders_are_moved_only_to_free_names(spark, tmp_path):
    (tmp_path / "a" / "x").mkdir(parents=True)
    shared.rename(spark, f"{tmp_path}/a", f"{tmp_path}/b/c")
    assert shared.folders(spark, f"{tmp_path}/b/c") == ["x"] and shared.folders(spark, f"{tmp_path}/none") == []
    (tmp_path / "a").mkdir()
    with pytest.raises(FileExistsError):
        shared.rename(spark, f"{tmp_path}/a", f"{tmp_path}/b/c")


def test_hashes_of_files(spark, tmp_path):
    top = tmp_path / "t"
    (top / "part=1").mkdir(parents=True)
    for name, data in (("a", b"one"), ("part=1/b", b"two" * 70_000), ("_SUCCESS", b""), (".hidden", b"no")):
        (top / name).write_bytes(data)
    one = shared.tree_hash(spark, f"file://{top}")
    assert (one["files"], one["bytes"]) == (2, 210_003)
    assert shared.tree_hash(spark, f"file://{top}/a")["sha256"] == hashlib.sha256(b"one").hexdigest()
    os.rename(top / "a", top / "z")
    assert shared.tree_hash(spark, f"file://{top}") == one
    changed = bytearray((top / "part=1" / "b").read_bytes())
    changed[100_001] ^= 1
    (top / "part=1" / "b").write_bytes(bytes(changed))
    two = shared.tree_hash(spark, f"file://{top}")
    assert two["sha256"] != one["sha256"] and two["bytes"] == one["bytes"]
