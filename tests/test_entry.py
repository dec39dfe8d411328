import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
ASK = """
import sys
sys.path.insert(0, ".")
import __spark_entry__ as e
from pyspark.sql import SparkSession
q, o = e.queries(), e.oracle_sql()
assert len(q) >= 42 and all(name.startswith("q") for name in q), sorted(q)
assert set(o) <= set(q)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", q["q01_scan_foreach"](spark, "/root/testdata/sf0.001").count())
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_entry_works_without_the_llm_folders(tmp_path, pipeline):
    left_out = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(REPO, tmp_path / "copy", ignore=left_out)
    done = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "rows 150" in done.stdout
