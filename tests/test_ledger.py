"""Calls that are written down: lost tasks, runs that are started again, streams with a memo."""

import os
import sys

import pytest
from pyspark import cloudpickle

from termloom.operators import guards
from termloom.operators.ledger import Ledger
from termloom.schema import TABLE_CELLS
from termloom.streaming import incremental

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Counted:
    """Upper case; notes every text that it is asked for, and fails at one of them as long as a file is there."""

    def __init__(self, folder, bad=None):
        self.folder, self.bad = str(folder), bad

    def __call__(self, prompts, texts, budgets, temperature, seed):
        if self.bad in texts and os.path.exists(f"{self.folder}/down"):
            raise OSError("the model is away")
        with open(f"{self.folder}/calls", "a") as f:
            f.write("".join(f"{t}\n" for t in texts))
        return [None if t == "mute" else t.upper() for t in texts]

    def calls(self):
        with open(f"{self.folder}/calls") as f:
            return sorted(f.read().split("\n")[:-1])


def test_a_run_that_is_started_again_asks_for_the_rest(spark, tmp_path):
    texts = spark.createDataFrame([(i, f"word {i % 20}") for i in range(60)] + [(90, None), (91, ""), (92, "mute")], "k int, t string")
    (tmp_path / "down").touch()
    model, ledger = Counted(tmp_path, "word 7"), Ledger(f"file://{tmp_path}/ledger", every=1, digits=1)
    run = lambda: {r["k"]: r["translated"] for r in guards.guarded_translation(texts, "k", "t", model, lambda d: d.checkpoint(), ledger=ledger).collect()}
    with pytest.raises(Exception, match="the model is away"):
        run()
    before = model.calls()
    os.remove(tmp_path / "down")
    got = run()
    assert got == {i: f"WORD {i % 20}" for i in range(60)} | {90: None, 91: "", 92: "mute"}
    # sixty rows are twenty calls, each made once over both runs; no answer is asked for again
    assert sorted(c for c in model.calls() if c not in ("mute", "")) == sorted(f"word {i}" for i in range(20)) and before
    assert run() == got and [c for c in model.calls() if c.startswith("word")] == sorted(f"word {i}" for i in range(20))
    assert ledger.answers(spark).count() == 21


def test_a_lost_task_repeats_one_batch_at_most(tmp_path):
    import pandas as pd

    (tmp_path / "down").touch()
    model, ledger = Counted(tmp_path, "t5"), Ledger(f"{tmp_path}/ledger", every=2)
    rows = pd.DataFrame({"_call": [f"00{i}" for i in range(8)], "prompt": "p", "masked": [f"t{i}" for i in range(8)], "budget": 30, "_bucket": "00"})
    task = ledger._task(model, "run", 0.3, 42)
    with pytest.raises(OSError):
        list(task(iter([rows])))
    assert model.calls() == ["t0", "t1", "t2", "t3"]
    os.remove(tmp_path / "down")
    list(task(iter([rows])))
    assert model.calls() == [f"t{i}" for i in range(8)]
    # a second copy of the task finds everything written, and no half-written file is left
    list(task(iter([rows])))
    assert len(model.calls()) == 8 and not [f for f in os.listdir(tmp_path / "ledger/bucket=00") if f.startswith("_")]


def test_cells_of_earlier_batches_are_not_sent_again(spark, tmp_path):
    model = Counted(tmp_path)
    folders = {n: f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint", "memo")}

    def batch(cells):
        spark.createDataFrame([("d", 0, i, 0, t) for i, t in enumerate(cells)], TABLE_CELLS).coalesce(1).write.mode("append").parquet(folders["in"])
        query = incremental.translated_cells(spark, folders["in"], TABLE_CELLS, model, folders["out"], folders["checkpoint"], folders["memo"])
        assert query.awaitTermination(240)

    batch(["apple", "apple ", "pear", "42", "", None])
    assert model.calls() == ["apple", "pear"]
    # a new query over the same checkpoint, as after a restart
    batch(["pear", "apple", "plum"])
    assert model.calls() == ["apple", "pear", "plum"]
    out = spark.read.parquet(folders["out"]).where("batch = 1")
    assert {(r["text"], r["translated"]) for r in out.collect()} == {("pear", "PEAR"), ("apple", "APPLE"), ("plum", "PLUM")}
