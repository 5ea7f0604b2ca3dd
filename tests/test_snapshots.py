"""Snapshots that are whole or not there."""

import json

import pytest

from folio.sources.snapshots import FILES, SCHEMAS, Snapshots, SnapshotExists, add_to, read_json_state, used_names, write_json_state


def state(spark, n):
    return {
        "processed": spark.createDataFrame([(f"h{i}", f"s{i}", f"t{i}") for i in range(n)], SCHEMAS["processed"]),
        "pending": spark.createDataFrame([("f.pdf", "A", "", "", f"s{n}")], SCHEMAS["pending"]),
        "person_index": spark.createDataFrame([("A", f"a{n}", "", "")], SCHEMAS["person_index"]),
    }


def rows(tables):
    return {name: sorted(map(tuple, df.collect())) for name, df in tables.items()}


class Killed(Exception):
    pass


class Dying:
    """A table whose write never ends."""

    def __init__(self, df):
        self.schema, self.write = df.schema, self

    def mode(self, _):
        return self

    def parquet(self, _):
        raise Killed


def test_a_run_killed_between_two_tables_leaves_the_state_before(spark, tmp_path):
    shots = Snapshots(spark, str(tmp_path / "state"))
    assert rows(shots.load()) == {name: [] for name in SCHEMAS}
    one, two = state(spark, 1), state(spark, 2)
    assert shots.save(one) == 1 and rows(shots.load()) == rows(one)
    with pytest.raises(Killed):
        shots.save(two | {"pending": Dying(two["pending"])})
    assert (tmp_path / "state/number=2/processed").exists()
    assert shots.numbers() == [1] and rows(shots.load()) == rows(one)
    assert shots.save(two) == 2 and rows(shots.load()) == rows(two) and rows(shots.load(1)) == rows(one)


def test_a_snapshot_is_never_written_over(spark, tmp_path):
    shots = Snapshots(spark, str(tmp_path / "state"))
    shots.save(state(spark, 1))
    with pytest.raises(SnapshotExists):
        shots.save(state(spark, 2), number=1)
    with pytest.raises(SnapshotExists):
        shots._commit(1, {})  # as if another run had been faster
    assert rows(shots.load()) == rows(state(spark, 1))
    assert [p.name for p in (tmp_path / "state/manifests").iterdir() if not p.name.startswith(".")] == ["1.json"]


def test_a_state_grows_from_its_last_snapshot_and_old_ones_go(spark, tmp_path):
    shots = Snapshots(spark, str(tmp_path / "state"))
    for n in (1, 3, 2):
        shots.save(add_to(shots.load(), state(spark, n)))
    got = rows(shots.load())
    assert [r[0] for r in got["processed"]] == ["h0", "h1", "h2"] and got["pending"] == [("f.pdf", "A", "", "", "s2")]
    assert [r[1] for r in got["person_index"]] == ["a1", "a2", "a3"]
    shots.keep(1)
    assert shots.numbers() == [3] and rows(shots.load()) == got
    assert not (tmp_path / "state/number=1").exists()


def test_json_in_and_out(spark, tmp_path):
    (tmp_path / FILES["processed"]).write_text(json.dumps({"h1": {"kaynak": "tarama1.pdf", "hedef": "ayşe.pdf"}, "hedef:x": {"kaynak": "q\"", "hedef": "y"}}, ensure_ascii=False, indent=2), encoding="utf-8")
    (tmp_path / FILES["person_index"]).write_text(json.dumps({"AYSE": [{"isim": "Ayşe", "tc_no": "1", "sicil_no": ""}, {"isim": "AYŞE"}]}, ensure_ascii=False), encoding="utf-8")
    tables = read_json_state(spark, str(tmp_path))
    want = {"processed": [("h1", "tarama1.pdf", "ayşe.pdf"), ("hedef:x", 'q"', "y")], "pending": [], "person_index": [("AYSE", "AYŞE", "", ""), ("AYSE", "Ayşe", "1", "")]}
    assert rows(tables) == want
    (tmp_path / "out").mkdir()
    write_json_state(tables, str(tmp_path / "out"))
    written = json.loads((tmp_path / "out" / FILES["processed"]).read_text(encoding="utf-8"))
    assert written == {"h1": {"kaynak": "tarama1.pdf", "hedef": "ayşe.pdf"}, "hedef:x": {"kaynak": 'q"', "hedef": "y"}}
    assert json.loads((tmp_path / "out" / FILES["pending"]).read_text()) == {}
    assert rows(read_json_state(spark, str(tmp_path / "out"))) == want


def test_used_names(spark):
    files = [("archive", "a.pdf"), ("verify", "a.pdf"), ("verify", "b_2.pdf"), ("error", "c.pdf"), ("archive", "d.txt"), ("archive", None)]
    assert sorted(r.name for r in used_names(spark.createDataFrame(files, "folder string, file string")).collect()) == ["a", "b_2"]
