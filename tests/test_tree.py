import os
import subprocess

import pytest
from pyspark.sql import functions as F

from lodestone.plans import hooks
from lodestone.plans.cli import main
from lodestone.sources import files, tree

FILES = (
    "pkg/__init__.py", "pkg/_util.py", "pkg/app.py", "_private/m.py", ".github/workflows/ci.yml", ".env.local.json", ".env", "a.PY", "notes.txt", "Makefile", "sub/Dockerfile", "package-lock.json",
    "node_modules/x/index.js", "sub/node_modules/y.js", ".git/config.json", "sub/build/z.py", "big.py", "gen/auto_made.py", "gen/kept.py", "é/naïve.py", "sub/deep/App.java", "App.java",
)


@pytest.fixture
def folder(tmp_path):
    for name in FILES:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * (files.MAX_BYTES + 1) if name == "big.py" else f"# {name}\r\n".encode())
    return tmp_path


def walked(root, excludes=()):
    """What a scan reads, by a walk of the file system."""
    out = []
    for at, folders, names in os.walk(root):
        folders[:] = [d for d in folders if d not in files.SKIP_DIRECTORIES]
        for n in names:
            path = os.path.join(at, n)
            if n in files.SKIP_NAMES or (os.path.splitext(n)[1].lower() not in files.EXTENSIONS and n not in files.NAMES) or os.path.getsize(path) > files.MAX_BYTES:
                continue
            if not any(e in path for e in excludes):
                out.append(path)
    return sorted(out)


def test_the_same_files_as_a_walk(spark, folder):
    got = files.from_tree(spark, str(folder)).collect()
    assert sorted(r.path for r in got) == walked(folder) and len(got) == 14
    assert {"__init__.py", "_util.py", "m.py", "ci.yml", ".env.local.json", "a.PY"} <= {r.name for r in got}
    assert {r.name: r.content for r in got}["__init__.py"] == "# pkg/__init__.py\n"
    assert sorted(r.path for r in files.from_tree(spark, str(folder), ["auto_", "_private/"]).collect()) == walked(folder, ["auto_", "/_private/"])
    assert [r.name for r in files.from_tree(spark, str(folder / "pkg/_util.py")).collect()] == ["_util.py"]
    assert files.from_tree(spark, str(folder / "nowhere")).collect() == []


def settings(**changed):
    return {"skip_directories": files.SKIP_DIRECTORIES, "skip_names": files.SKIP_NAMES, "extensions": files.EXTENSIONS, "names": files.NAMES, "excludes": [], "max_bytes": files.MAX_BYTES} | changed


def test_pruned_folders_are_never_listed(folder):
    reader = tree.TreeReader(str(folder), settings())
    assert sorted(p for p, _ in reader.walk()) == walked(folder)
    assert not [f for f in reader.listed if any(part in files.SKIP_DIRECTORIES for part in f[len(str(folder)) :].split("/"))]


def test_partitions_by_bytes(folder, monkeypatch):
    monkeypatch.setattr(tree, "PARTITION_BYTES", 40)
    parts = tree.TreeReader(str(folder), settings()).partitions()
    assert len(parts) > 4 and all(sum(s for _, s in p.files) <= 40 or len(p.files) == 1 for p in parts)
    assert sorted(path for p in parts for path, _ in p.files) == walked(folder)


def test_filters_are_taken_before_files_are_read(spark, folder):
    rows = tree.read(spark, str(folder), settings())
    wanted = rows.filter((F.col("ext") == ".py") & (F.col("size") < 20) & F.col("path").startswith(str(folder)) & F.col("name").isin("kept.py", "app.py", "m.py"))
    assert sorted(r.name for r in wanted.select("name").collect()) == ["app.py", "kept.py", "m.py"]
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan or "StartsWith" not in plan.split("BatchScan")[0]
    reader = tree.TreeReader(str(folder), settings())
    left = list(reader.pushFilters([tree.EqualTo(("ext",), ".py"), tree.EqualTo(("content",), b"x"), tree.LessThan(("size",), 100)]))
    assert left == [tree.EqualTo(("content",), b"x")] and {os.path.splitext(p)[1].lower() for p, _ in reader.walk()} == {".py"}


def git(folder, *command):
    subprocess.run(["git", "-C", str(folder), "-c", "user.name=t", "-c", "user.email=t@t", *command], check=True, capture_output=True)


def test_only_what_is_staged(spark, folder):
    git(folder, "init", "-q")
    git(folder, "add", "App.java", "é/naïve.py")
    paths = files.git_paths(spark, str(folder), staged=True)
    assert sorted(r.path for r in paths.collect()) == ["App.java", "é/naïve.py"]
    got = files.scannable(files.from_tree(spark, str(folder)), paths, str(folder))
    assert sorted(r.path for r in got.collect()) == sorted([f"{folder}/App.java", f"{folder}/é/naïve.py"])


def test_a_hook_without_rules_scans_with_the_starter_rules(spark, folder):
    text = hooks.script("pre-commit", "critical", None)
    assert "nothing scanned" not in text.split("exec")[1] and "${rules:+--rules" in text
    (folder / "pkg/__init__.py").write_text('password = "q8Zr2LmX0vTn7KsB4yHdW1cP"\n')
    git(folder, "init", "-q")
    git(folder, "add", "pkg/__init__.py")
    assert main([str(folder), "--staged", "--fail-on", "low"], spark) == 1
