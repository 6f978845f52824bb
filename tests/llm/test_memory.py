"""Python workers that Spark keeps for later steps hold little of what a task has used."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

WORKER = """
import random, re
import pyarrow as pa
from claimledger.llm.sentencepieces import MODEL, segment_batches

def anonymous():
    return int(re.search(r"\\nAnonymous: +(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

def task(rows):
    draw = random.Random(3)
    for first in range(0, rows, 1000):
        texts = [" ".join("".join(draw.choices("abcdefghijklmnopqrst", k=draw.randint(3, 9))) for _ in range(150)) for _ in range(first, min(rows, first + 1000))]
        yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(texts))), pa.array(texts)], names=["doc_id", "text"])

def run(rows):
    return sum(b.num_rows for b in segment_batches(task(rows), 2, 5, MODEL, 300_000))

run(20)
before = anonymous()
made = run(2000)
print(made, anonymous() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory is read from /proc")
def test_a_worker_returns_the_memory_of_an_encoding_task():
    root = Path(__file__).parents[2]
    ran = subprocess.run([sys.executable, "-c", WORKER], cwd=root, capture_output=True, text=True, timeout=300, check=True)
    made, kept_mb = ran.stdout.split()
    assert int(made) == 4000
    assert float(kept_mb) < 50
