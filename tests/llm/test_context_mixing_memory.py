"""What tasks of context mixing hold and hand back at once."""
from collections import Counter

import numpy as np
import pandas as pd

from tallyforge.llm import context_mixing as cm
from tests.llm.test_worker_memory import task_of


def test_words_are_handed_back_a_few_at_a_time(monkeypatch):
    monkeypatch.setattr(cm, "HANDED", 10)
    texts = [f"w{i} w{i % 7} the" for i in range(50)]
    found = [f for f in task_of(cm.token_counts)(iter([pd.DataFrame({"text": texts})])) if (f["kind"] == "w").all()]
    assert max(map(len, found)) <= 10
    all_ = pd.concat(found)
    assert dict(zip(all_["key"], all_["n"])) == Counter(w.encode() for t in texts for w in t.split())


def test_tallies_add_up():
    rng = np.random.default_rng(4)
    parts = [rng.integers(0, 30, n).astype(np.uint32) for n in (100, 1, 57)]
    want = Counter(np.concatenate(parts).tolist())
    total = pd.DataFrame({"key": np.empty(0, np.int64), "n": np.empty(0, np.int64)})
    assert len(cm._together(total, total)) == 0
    for p in parts:
        total = cm._together(total, cm._tally([p]))
    assert dict(zip(total["key"], total["n"])) == want and total["key"].is_monotonic_increasing
    packed = cm._packed(list(cm._cut(total, 7)))
    assert np.frombuffer(packed["key"][0], np.int64).tolist() == total["key"].tolist()
    assert np.frombuffer(packed["n"][0], np.int64).tolist() == total["n"].tolist()
