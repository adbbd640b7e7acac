"""Plans carried out on generated files: nothing by default, names handed round, runs stopped anywhere, tasks that run twice."""

import os

import pytest

from quarrylight.plans import carry

PLAN = "src_path string, dst_path string, item_id int"


def make(folder, *names):
    for name in names:
        at = folder / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(name)


def files(folder):
    return {os.path.relpath(os.path.join(d, n), folder): open(os.path.join(d, n)).read() for d, _, names in os.walk(folder) for n in names}


def plan(spark, *moves):
    return spark.createDataFrame([(*m, 1) for m in moves], PLAN)


def states(df):
    return {r["src_path"]: r["state"] for r in df.collect()}


ROUND = (("a", "b"), ("b", "c"), ("c", "in/a"), ("gone", "x"), ("d", "taken"), ("e", None))


def test_nothing_without_execute(spark, tmp_path):
    make(tmp_path / "f", "a", "b")
    assert states(carry.carry_out(plan(spark, ("a", "c"), ("b", None)), str(tmp_path / "f"), str(tmp_path / "j"))) == {"a": "planned"}
    assert files(tmp_path / "f") == {"a": "a", "b": "b"} and not (tmp_path / "j").exists()


def test_names_handed_round(spark, tmp_path):
    folder = tmp_path / "f"
    make(folder, "a", "b", "c", "d", "e", "taken")
    for _ in range(2):  # the second run finds all done
        got = carry.carry_out(plan(spark, *ROUND), f"file://{folder}", str(tmp_path / "j"), execute=True)
        assert states(got) == {"a": "moved", "b": "moved", "c": "moved", "gone": "missing", "d": "restored"}
        assert files(folder) == {"b": "a", "c": "b", "in/a": "c", "d": "d", "taken": "taken", "e": "e"}
    rows = spark.createDataFrame([("a", 1), ("d", 2), ("e", 3)], "path string, n int")
    assert sorted(map(tuple, carry.after(rows, got).collect())) == [("b", 1), ("d", 2), ("e", 3)]


@pytest.mark.parametrize("stop", ["planned", "aside", "half aside", "half done"])
def test_stopped_and_run_again(spark, tmp_path, monkeypatch, stop):
    """A run ends between the phases, or in one with some files moved; the next goes on from the journal, whatever plan it is given."""
    folder = tmp_path / "f"
    make(folder, "a", "b", "c", "d", "e", "taken")
    phase, calls = carry._phase, []

    def dying(rows, top, step, copy):
        calls.append(step)
        if stop == "planned" or stop == "aside" and len(calls) == 2:
            raise KeyboardInterrupt
        if stop == "half aside" and len(calls) == 1 or stop == "half done" and len(calls) == 2:
            phase(rows.filter("src_path in ('a', 'c')"), top, step, copy).collect()  # done, but not in the journal
            raise KeyboardInterrupt
        return phase(rows, top, step, copy)

    monkeypatch.setattr(carry, "_phase", dying)
    with pytest.raises(KeyboardInterrupt):
        carry.carry_out(plan(spark, *ROUND), str(folder), str(tmp_path / "j"), execute=True)
    monkeypatch.setattr(carry, "_phase", phase)
    got = carry.carry_out(plan(spark, ("a", "elsewhere")), str(folder), str(tmp_path / "j"), execute=True)
    assert states(got) == {"a": "moved", "b": "moved", "c": "moved", "gone": "missing", "d": "restored"}
    assert files(folder) == {"b": "a", "c": "b", "in/a": "c", "d": "d", "taken": "taken", "e": "e"}


def test_tasks_that_run_twice(spark, tmp_path):
    folder = tmp_path / "f"
    make(folder, "a", "b")
    store, top = carry.store_of(str(folder))
    for step, says in ((carry._set_aside, "aside"), (carry._put_in_place, "moved")):
        for _ in range(2):
            assert step(store, f"{top}/a", f"{top}/.t", f"{top}/n", False) == says
    assert files(folder) == {"n": "a", "b": "b"}


def test_copies(spark, tmp_path):
    folder = tmp_path / "f"
    make(folder, "a", "b", "taken")
    got = carry.carry_out(plan(spark, ("a", "x/a"), ("b", "taken")), str(folder), str(tmp_path / "j"), execute=True, copy=True)
    assert states(got) == {"a": "moved", "b": "restored"} and files(folder) == {"a": "a", "b": "b", "x/a": "a", "taken": "taken"}
    assert carry.carry_out(plan(spark).limit(0), str(folder), str(tmp_path / "j2"), execute=True).count() == 0
