import json
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_contract(spark):
    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known)
    assert __spark_entry__.entry(spark).count() == 10


def test_imports_without_the_training_data_operators(tmp_path):
    """Nothing but the entry point knows of the subpackage, and that goes without it."""
    for part in ("corvine", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / part), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "corvine/llm")], check=True)
    code = "import json, __spark_entry__ as e; print(json.dumps(sorted(e.queries())))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    names = json.loads(out.stdout.strip().splitlines()[-1])
    assert "bm25_topk" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
