"""The walk of folders: what is cut off is never opened, and what is found is what the ignore rules leave."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from twinlens.sources import files


def build(root, names):
    for n in names:
        p = Path(root, n)
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(n)


def plain(root, git):
    """Every file below the root that no rule, folder or link holds back, by the rules of all ignore files at once."""
    found, rules = [], []
    for top, _, names in os.walk(root):
        for n in names:
            if n in files.IGNORE_FILES and (git or n == ".ignore"):
                rules.append((os.path.relpath(os.path.join(top, n), root), Path(top, n).read_text()))
    rules = files.ignore_rules(rules)
    for top, folders, names in os.walk(root):
        inside = os.path.relpath(top, root)
        parts = [] if inside == "." else inside.split("/")
        folders[:] = [f for f in folders if f not in files.IGNORED_DIRECTORIES and not os.path.islink(os.path.join(top, f)) and not files.takes_out(rules, "/".join([*parts, f]), True)]
        found += [os.path.join(top, n) for n in names if not os.path.islink(os.path.join(top, n)) and not files.takes_out(rules, "/".join([*parts, n]), False)]
    return sorted(found)


@pytest.mark.parametrize("git", [True, False])
def test_the_walk_finds_what_rules_leave(spark, tmp_path, git):
    build(tmp_path, ["a.ts", "src/b.ts", "src/deep/er/c.ts", "node_modules/x/y.ts", "src/node_modules/z.ts", "out/d.ts", "out/keep.ts", ".hidden/e.ts", "_under/f.ts", "src/gen/g.ts", "src/gen/h.js", "logs/i.log", "sub dir/j.ts", "build/k.ts"])
    (tmp_path / ".gitignore").write_text("out/*\n!out/keep.ts\n*.log\n/logs/\n")
    (tmp_path / "src" / ".ignore").write_text("gen/\n")
    os.symlink(tmp_path / "src", tmp_path / "link")
    os.symlink(tmp_path / "a.ts", tmp_path / "src" / "l.ts")
    found, opened = files.walk(spark, str(tmp_path), git)
    rows = sorted((r["path"], r["bytes"]) for r in found.collect())
    assert [p for p, _ in rows] == plain(str(tmp_path), git) and all(n == os.path.getsize(p) for p, n in rows)
    seen = {os.path.relpath(r["path"], tmp_path) for r in opened.collect()}
    assert "src/deep/er" in seen and not any(x in seen for x in ("node_modules", "src/node_modules", "build", "src/gen", "link")) and ("logs" in seen) == (not git)


def test_a_thousand_pruned_folders_are_never_opened(spark, tmp_path):
    build(tmp_path, [f"node_modules/m{i}/index.ts" for i in range(1000)] + [f"skip/s{i}/x.ts" for i in range(200)] + ["src/a.ts"])
    (tmp_path / ".ignore").write_text("skip\n")
    found, opened = files.walk(spark, str(tmp_path))
    assert opened.count() == 2 and sorted(os.path.basename(r["path"]) for r in found.collect()) == [".ignore", "a.ts"]


def test_rules_above_the_root(spark, tmp_path):
    build(tmp_path, ["p/q/a.ts", "p/q/b.js", "p/q/r/c.ts"])
    outer = (files.Outer("p/q", ".gitignore", "*.js\np/q/r/\n"),)
    found, opened = files.walk(spark, f"{tmp_path}/p/q", True, outer)
    assert [os.path.basename(r["path"]) for r in found.collect()] == ["a.ts"] and opened.count() == 1
    assert files.walk(spark, f"{tmp_path}/p/q", True, (files.Outer("p/q", ".gitignore", "p\n"),))[0].collect() == []


def test_contents_are_read_by_tasks(spark, tmp_path):
    (tmp_path / "a.ts").write_bytes(b"x\xff\n")
    (tmp_path / "b.ts").write_bytes(b"")
    rows = files.read_files(files.walk(spark, str(tmp_path))[0]).select("path", "text", F.col("content").alias("c")).collect()
    assert sorted((os.path.basename(r["path"]), r["text"], bytes(r["c"])) for r in rows) == [("a.ts", "x�\n", b"x\xff\n"), ("b.ts", "", b"")]


def test_a_store_by_uri(tmp_path):
    build(tmp_path, ["a.ts", "f/b.ts"])
    assert files._entries(f"file://{tmp_path}") == [("a.ts", "file", 4), ("f", "folder", 0)] and files._content(f"file://{tmp_path}/a.ts") == b"a.ts"
