"""Workers are kept for later tasks; what a task has freed does not stay with them."""

import subprocess
import sys
from pathlib import Path

FREED = """
import numpy as np
from grainmill.llm.arrow import tidy
rss = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20
before = rss()
blocks = [np.ones(8000) for _ in range(3000)]
last = blocks.pop()  # holds the heap's end
most = rss()
del blocks
list(tidy(lambda batches: batches)(iter([])))
print(most - before, rss() - before)
"""


def test_freed_memory_goes_back_after_a_task():
    root = Path(__file__).resolve().parents[2]
    said = subprocess.run([sys.executable, "-c", FREED], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) > 150 and int(said[1]) < 60
