from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

#: With one core, workers that are there at the end beyond the first were needed by one task at the same time. The table is
#: made without Python, which would start a worker of its own.
COUNTED = """
from pathlib import Path
from pyspark.sql import SparkSession
from regionlink.llm.suffix_dedup import suffix_dedup

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
passage = " ".join(f"word{i}" for i in range(60))
n = len(passage)
texts = [f"'{passage}'", f"'before {passage}'", f"'{passage} after'", f"'{passage}'", "repeat('x ', 400)", "NULL"]
table = spark.sql(f"SELECT * FROM VALUES {', '.join(f'({i}, {t})' for i, t in enumerate(texts))} AS t(doc_id, text)")

def below(pid):
    return [int(c) for t in Path(f"/proc/{pid}/task").iterdir() for c in (t / "children").read_text().split()]

for limit in ("-1", "10m"):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    found = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup(table).collect()}
    assert found == {0: (n, n), 1: (n + 7, n), 2: (n + 6, n), 3: (n, n), 4: (800, 800), 5: (0, 0)}, found
    print(limit, [len(below(daemon)) for daemon in below(spark.sparkContext._gateway.proc.pid)])
"""


def test_a_task_of_op7_needs_one_worker(tmp_path):
    """Joins by exchange and, where tables are small, by broadcast."""
    (tmp_path / "counted.py").write_text(COUNTED)
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(Path(__file__).resolve().parents[2]), os.environ.get("PYTHONPATH", "")])}
    ran = subprocess.run([sys.executable, str(tmp_path / "counted.py")], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert ran.stdout.split("\n")[:-1] == ["-1 [1]", "10m [1]"], ran.stdout + ran.stderr[-2000:]
