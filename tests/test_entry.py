import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and 0 <= rows[0].risk_score <= 1


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_llm_folder(tmp_path):
    shutil.copytree(ROOT / "loomspark", tmp_path / "loomspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') and k[2].isdigit() for k in q), 'pipeline' in q)"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    n, ops, pipeline = said.stdout.split()
    assert int(n) > 60 and (ops, pipeline) == ("False", "False")
