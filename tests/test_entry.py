"""The entry imports with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
SAY = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), sum(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q))"


def said(root):
    done = subprocess.run([sys.executable, "-c", SAY], cwd=root, env={"PYTHONPATH": str(root), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    return [int(x) for x in done.stdout.split()]


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_without_the_subpackage(tmp_path, also):
    for part in ("palimpsest", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / part).is_dir():
            shutil.copytree(ROOT / part, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif (ROOT / part).exists() and part not in also:
            shutil.copy(ROOT / part, tmp_path / part)
    total, optional = said(tmp_path)
    assert total > 50 and optional == 0


def test_a_broken_subpackage_is_not_forgiven(tmp_path):
    for part in ("palimpsest", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / part).is_dir():
            shutil.copytree(ROOT / part, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif (ROOT / part).exists():
            shutil.copy(ROOT / part, tmp_path / part)
    (tmp_path / "palimpsest" / "llm").mkdir()
    (tmp_path / "palimpsest" / "llm" / "__init__.py").write_text("")
    (tmp_path / "palimpsest" / "llm" / "registry.py").write_text("import no_such_module_anywhere\n")
    with pytest.raises(AssertionError, match="no_such_module_anywhere"):
        said(tmp_path)
