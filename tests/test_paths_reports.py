import json
import os

import pytest

from siltscope.__main__ import main
from siltscope.plans.analyzer import analyze_path
from siltscope.plans.report import report, to_json, to_text
from siltscope.sources.listing import in_complexity_scope, list_python_files, source_files

KEPT = ["__init__.py", "_private/a.py", ".hidden/b.py", ".py", "Build/k.py", "env/l.py", "site-packages/m.py", ".tox/n.py", ".eggs/o.py"]
LEFT = ["pkg/build/c.py", "venv/d.py", "node_modules/e.py", "dist/f.py", ".git/g.py", ".venv/h.py", "__pycache__/i.py", ".pytest_cache/j.py", "p.pyi", "q.PY", "r.txt"]


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "build"
    for name in KEPT + LEFT:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("def f(): pass\n" if name in (".tox/n.py", ".eggs/o.py") else "x = 1\n" if name != ".py" else "")
    (root / "bad_utf8.py").write_bytes(b"\xff\xfe")
    (root / "py2.py").write_text('print "dict"\n')
    (root / "bom.py").write_text("\ufeffimport redis\n")
    (root / "crlf.py").write_bytes(b"a\r\nb\r\n")
    (root / "dir.py").mkdir()
    os.symlink(root / "missing", root / "broken.py")
    return root


def test_listing(tree):
    got = list_python_files(str(tree))
    assert set(got) == {*KEPT, "bad_utf8.py", "py2.py", "bom.py", "crlf.py", "broken.py"}
    assert got.index("py2.py") < got.index(".hidden/b.py")  # a folder's files come before its sub-folders
    assert set(list_python_files(str(tree), "walk")) == set(got)
    assert list_python_files(str(tree / "py2.py")) == []
    assert [p for p in got if not in_complexity_scope(p)] == [".eggs/o.py", ".tox/n.py"]
    with pytest.raises(FileNotFoundError):
        list_python_files(str(tree / "nowhere"))


def test_reading(spark, tree):
    rows = {r.path: r for r in source_files(spark, str(tree)).collect()}
    assert rows["bad_utf8.py"].content is None and rows["broken.py"].read_error.startswith("FileNotFoundError")
    assert rows["crlf.py"].content == "a\nb\n" and rows["bom.py"].content.startswith("\ufeff")


def test_analysis_of_a_folder(spark, tree):
    a = analyze_path(spark, str(tree))
    r = a.rating.first()
    assert r.files_scanned == 12 and r.project == str(tree)
    hits = {(m.pattern, m.path) for m in a.matches.collect()}
    assert ("hash_map", "py2.py") in hits and ("caching", "bom.py") in hits
    assert a.summary.first().total_functions == 0
    with pytest.raises(OSError):
        analyze_path(spark, str(tree), errors="failfast").functions  # noqa: B018


def test_empty_folder(spark, tmp_path):
    t = report(analyze_path(spark, str(tmp_path)), with_complexity=True)
    assert (t["rating"], t["label"], t["complexity"]) == (1.0, "Poor - Minimal value, basic code", {"total_functions": 0})
    assert "No significant patterns detected." in to_text(t) and "Avg confidence: 0%" in to_text(t)


def test_reports(spark, tmp_path):
    (tmp_path / "a.py").write_text("def two(xs: list):\n    for x in xs:\n        for y in xs:\n            if x == y:\n                return x\n")
    (tmp_path / "b.py").write_text("import heapq\nlogger = 1\n")
    t = report(analyze_path(spark, str(tmp_path)), with_complexity=True)
    text = to_json(t)
    assert list(json.loads(text)) == ["project", "rating", "label", "breakdown", "dsa_patterns", "design_patterns", "complexity"] and "\\u00b2" in text
    assert t["complexity"]["high_complexity_functions"] == [{"name": "two", "file": "a.py", "line": 1, "time": "O(n²)", "space": "O(1)", "confidence": 0.8, "dominant_op": "nested loops (depth 2)", "reasoning": ["Parameters: 1 (1 typed)", "Nested loops (depth 2) → O(n²)", "No significant allocations → O(1)"]}]
    assert t["dsa_patterns"]["sorting"] == {"files": ["b.py"], "description": "Sorting algorithms and ordered operations"}
    shown = to_text(t, verbose=True)
    assert "⚠ 1 high-complexity function(s):" in shown and "└─ b.py" in shown and "• Parameters: 1 (1 typed)" in shown and "80%" in shown


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.py").write_text("import redis\n")
    assert main([str(tmp_path), "-f", "json", "-c"]) == 0
    assert json.loads(capsys.readouterr().out)["design_patterns"]["caching"]["files"] == ["a.py"]
    with pytest.raises(SystemExit):
        main([str(tmp_path / "missing")])
