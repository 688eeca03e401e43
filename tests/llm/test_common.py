import re
import weakref
from pathlib import Path

import numpy as np
import pandas as pd

from corpus_engine.llm.common import give_back_driver, tidy


class Held:
    """A hundred MB in small arrays."""

    def __init__(self):
        self.parts = [np.ones(12_500) for _ in range(1_000)]


def own_mb(pid="self") -> float:
    return int(re.search(r"Pss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024


def test_a_worker_gives_its_memory_back():
    """What a task has freed does not stay with its worker, though something lies above it."""
    above, died = [], []

    def run(batches):
        held = Held()
        died.append(weakref.ref(held))
        above.extend(np.ones(100) for _ in range(2_000))
        for batch in batches:
            yield batch

    list(tidy(run)(iter([])))  # what is made once does not count
    above.clear()
    before = own_mb()
    frames = [pd.DataFrame({"x": [1]}), pd.DataFrame({"x": [2]})]
    assert [f["x"][0] for f in tidy(run)(iter(frames))] == [1, 2]
    assert all(d() is None for d in died) and own_mb() - before < 40
    above.clear()
    list(run(iter(frames)))  # as it would be otherwise
    assert own_mb() - before > 60


def test_the_driver_gives_its_memory_back(spark):
    """What the driver's JVM has freed outside its heap does not stay with it, though something lies above it."""
    jvm = spark._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    give_back_driver(spark)
    held = [jvm.java.util.zip.Deflater() for _ in range(400)]
    for one in held[:-1]:
        one.end()
    before = own_mb(pid)
    give_back_driver(spark)
    assert before - own_mb(pid) > 15
    held[-1].end()
