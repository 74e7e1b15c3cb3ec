"""What a Python worker of the pipeline holds: an executor has several beside its heap."""

import re
import subprocess
import sys
import tracemalloc
from pathlib import Path

import pyarrow as pa
import pytest

from brindle.llm import decontaminate
from brindle.llm import textkit as tk

ITEM = " ".join(f"w{i}" for i in range(40))


def peak_mb(texts: list[str], size: int) -> float:
    items = decontaminate.Items([1], [ITEM], decontaminate.THRESHOLD, decontaminate.RADIUS)
    batch = pa.record_batch([pa.array(texts)], ["text"])
    tk.powers(size + 1)
    tracemalloc.start()
    found = 0
    for _, data, offsets in tk.chunks(iter([batch]), "text", size):
        found += len(items.matches(tk.Words(data, offsets)))
    peak = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    assert found == len(texts)
    return peak


def test_contaminated_texts_take_no_more_memory():
    """Every text holds the item, many times over: all its windows are fingerprinted."""
    assert peak_mb([f"{ITEM} {ITEM} {ITEM}"] * 100, 1 << 19) < 60


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="needs Linux")
def test_worker_gives_memory_back():
    code = """
import re, sys
import numpy as np, pyarrow as pa
from brindle.llm import decontaminate, textkit as tk
anon = lambda: int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
class Kept:
    sparkSession = schema = None
    def mapInArrow(self, run, schema):
        self.run = run
        return self
decontaminate._slices = lambda *a: iter([decontaminate.Items([1], ["seven words stand in this benchmark item"], 0.6, 23)])
run = decontaminate.drop_contaminated(Kept(), None).run
rng = np.random.default_rng(5)
def feed():
    for _ in range(3):
        yield pa.record_batch([pa.array([" ".join(f"v{x}" for x in rng.integers(0, 50000, 400)) for _ in range(4000)])], ["text"])
tk.powers(1 << 21)
before = anon()
n = sum(x.num_rows for x in run(feed()))
print(n, anon() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, timeout=100)
    rows, kept = re.match(r"(\d+) (-?[\d.]+)", out.stdout).groups() if out.returncode == 0 else pytest.fail(out.stderr)
    assert int(rows) == 12000
    assert float(kept) < 25
