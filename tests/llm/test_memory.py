"""What Python tasks hold: rows of a batch, and memory once it is free."""

import re
from pathlib import Path

import pyarrow as pa

from tidemark.llm import common


def test_batches_of_python_tasks_are_bounded(spark):
    common.ship(spark)
    rows = spark.range(5000, numPartitions=1).mapInArrow(lambda batches: (pa.record_batch({"n": [b.num_rows]}) for b in batches), "n bigint").collect()
    sizes = [r["n"] for r in rows]
    assert sum(sizes) == 5000 and max(sizes) <= 1024


def test_python_tasks_give_free_memory_back():
    def resident():
        return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) // 1024

    kept = []

    def task(batches):
        for batch in batches:
            blocks = [b"x" * 8192 for _ in range(12_000)]
            kept.append(b"x" * 8192)  # above the blocks, which are free but not at the top
            del blocks
            yield batch

    batch = pa.record_batch({"n": [1]})
    before = resident()
    assert list(common.lean(task)(iter([batch]))) == [batch]
    assert resident() - before < 40
