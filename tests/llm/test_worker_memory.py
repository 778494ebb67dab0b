"""What a Python worker holds between and during tasks."""
import ctypes
import re
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from tallyforge.llm import decontaminate, shared


class Captured(Exception):
    pass


class Rows:
    """Stands for a table: keeps the function that its tasks would run."""

    def mapInPandas(self, task, schema):
        self.task = task
        raise Captured


def task_of(make, *args):
    rows = Rows()
    with pytest.raises(Captured):
        make(rows, *args)
    return rows.task


def megabytes() -> float:
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="the C library keeps what is freed")
def test_a_task_leaves_no_freed_memory_behind():
    last = []

    def task(batches):
        held = [np.ones(8000) for _ in range(2000)]  # 128 MB in blocks too small for pages of their own
        last.append(np.ones(8000))  # what stays lies behind them
        yield from (b + len(held) for b in batches)

    before = megabytes()
    assert list(shared.lean(task)(iter([1, 2]))) == [2001, 2002]
    assert megabytes() - before < 40


def test_a_worker_forgets_what_other_tasks_remember():
    made = []
    word = lambda: shared.kept(("x",), lambda: made.append(1) or len(made))

    def user(batches):
        yield word()

    assert [*shared.lean(user, keeps=True)(iter([])), *shared.lean(user, keeps=True)(iter([]))] == [1, 1]
    list(shared.lean(lambda batches: iter(batches))(iter([])))
    assert list(shared.lean(user, keeps=True)(iter([]))) == [2]


def test_benchmark_tasks_remember_no_words():
    list(task_of(decontaminate._seed_rows)(iter([pd.DataFrame({"item_id": [1], "text": ["some few words of an item that is long enough for the masks here"]})])))
    assert not decontaminate._HASHES
