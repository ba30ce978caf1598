import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert {r.rule for r in rows} == {"lineitem_pkey", "lineitem_part", "quantity_positive", "discount_small"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_training_data_part(tmp_path):
    shutil.copytree(os.path.join(ROOT, "covenant"), tmp_path / "covenant", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not any(n.startswith('op') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
