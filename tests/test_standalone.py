"""The library without the optional parts."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _copy(to, *without):
    for name in ("staywise", "__spark_entry__.py", "corpus_pipeline.py"):
        src = os.path.join(REPO, name)
        if name in without or not os.path.exists(src):
            continue
        if os.path.isdir(src):
            shutil.copytree(src, to / name, ignore=shutil.ignore_patterns("__pycache__", *without))
        else:
            shutil.copy(src, to / name)


def _names(folder):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True)


def test_entry_without_the_optional_subpackage(tmp_path):
    _copy(tmp_path, "llm", "corpus_pipeline.py")
    out = _names(tmp_path)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "client_risk_summary" in out.stdout and "pipeline" not in out.stdout


def test_a_missing_library_is_not_swallowed(tmp_path):
    _copy(tmp_path)
    if not (tmp_path / "corpus_pipeline.py").exists():
        return
    (tmp_path / "xxhash.py").write_text("raise ModuleNotFoundError('no xxhash', name='xxhash')\n")
    out = _names(tmp_path)
    assert out.returncode != 0 and "no xxhash" in out.stderr


def test_nothing_else_imports_the_subpackage():
    for root, _, files in os.walk(os.path.join(REPO, "staywise")):
        if os.sep + "llm" in root:
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(root, f), encoding="utf-8") as src:
                    assert "staywise.llm" not in src.read(), f
