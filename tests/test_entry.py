"""The entry point with and without the subpackage for training data."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k.startswith('op') or k == 'pipeline' for k in q), sorted(set(e.oracle_sql()) - set(q)))"


def ask(folder):
    return subprocess.run([sys.executable, "-c", ASK], cwd=folder, capture_output=True, text=True, check=True).stdout.split(maxsplit=2)


def test_queries_load_without_the_training_data_folder(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "scoreloom", tmp_path / "scoreloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    left = ask(tmp_path)
    assert int(left[0]) > 100 and left[1:] == ["0", "[]\n"]
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert ask(tmp_path) == left
    assert int(ask(ROOT)[0]) - int(ask(ROOT)[1]) == int(left[0])


def test_workers_get_the_package_from_any_folder(tmp_path):
    """In a process that finds the package only by its own path."""
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[1])
    program = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import functions as F
from scoreloom import session
from scoreloom.functions import code
spark = session.build("local[1]", 1, **{{"spark.ui.enabled": "false"}})
session.ship(spark)
print("line", spark.range(1).select(code.open_call(F.lit("f(1)"), "f").alias("x")).first()["x"])
"""
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", program], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "line 1" in done.stdout, done.stderr[-2000:]
