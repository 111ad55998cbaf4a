"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["norm_hash", "lang", "copies", "lines", "nodes", "saves_nodes", "population", "path", "line"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rest_stands_without_the_llm_folder(tmp_path):
    """Without the subpackage and the pipeline, the entry imports and gives the other queries."""
    for f in ("__spark_entry__.py",):
        (tmp_path / f).write_text((REPO / f).read_text())
    for p in (REPO / "tesserae").rglob("*.py"):
        rel = p.relative_to(REPO)
        if "llm" not in rel.parts:
            (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / rel).write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'dupes_exact' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr
