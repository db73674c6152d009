from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

#: A worker goes to sleep at a text, the first time that one of them sees it. Tasks may fail four times.
STUCK = """
import os, sys, time
from pyspark.sql import SparkSession
from regionlink.llm import jaccard_join as J

spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
mark, words = sys.argv[1], J.tokens

def tokens(text, known=None):
    if text.startswith("halt") and not os.path.exists(mark):
        open(mark, "w").close()
        time.sleep(100_000)
    return words(text, known)

J.tokens, J.SILENT_S = tokens, 3
before = [spark.conf.get(f"spark.sql.execution.pyspark.udf.{x}", None) for x in ("idleTimeoutSeconds", "killOnIdleTimeout")]
table = spark.createDataFrame([(1, "halt here at the sixth word"), (2, "some other text of six words"), (3, "halt here at the sixth word"), (4, None)], "doc_id long, text string")
found = sorted(tuple(r) for r in J.jaccard_classes(table).collect())
assert os.path.exists(mark)
assert found == [(1, 2, 1), (2, 2, 2), (3, 2, 1), (4, 0, 4)], found
assert [spark.conf.get(f"spark.sql.execution.pyspark.udf.{x}", None) for x in ("idleTimeoutSeconds", "killOnIdleTimeout")] == before
print("whole")
"""


def test_a_task_whose_worker_is_stuck_runs_again(tmp_path):
    (tmp_path / "stuck.py").write_text(STUCK)
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(Path(__file__).resolve().parents[2]), os.environ.get("PYTHONPATH", "")])}
    ran = subprocess.run([sys.executable, str(tmp_path / "stuck.py"), str(tmp_path / "mark")], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert ran.stdout.split() == ["whole"], ran.stdout + ran.stderr[-2000:]
