"""File scans: a walk of folders that cuts ignored ones off before they are opened, and native filters by folder, globs and ignore files."""

from __future__ import annotations

import io
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import matches_any
from ..functions.scalars import normalize_path, path_parts
from ..functions.values import IGNORED_DIRECTORIES
from ..shared import Steps

IGNORE_FILES = (".gitignore", ".ignore")
#: Files that a task holds at once.
READ_AT_ONCE = 64


def taken(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether an include glob matches a normalised path and no exclude glob does."""
    return matches_any(path, include, "discovery.include") & ~matches_any(path, exclude, "discovery.exclude")


def keep_files(paths: DataFrame, root: str, include: list[str], exclude: list[str], excluded_paths: tuple[str, ...] = (), named: tuple[str, ...] = ()) -> DataFrame:
    """Distinct normalised ``path`` of a table of paths that an include glob matches and no exclude glob, ignored folder or excluded path does.

    ``named`` are normalised paths that were asked for one by one; ignored folders don't hold them back.
    """
    p = paths.select(normalize_path(F.col("path"), root).alias("path")).distinct()
    ignored = F.arrays_overlap(path_parts(F.col("path")), F.array(*map(F.lit, IGNORED_DIRECTORIES)))
    if named:
        ignored = ignored & ~F.col("path").isin(*named)
    kept = p.where(taken(F.col("path"), include, exclude) & ~ignored)
    return kept.where(~F.col("path").isin(*excluded_paths)) if excluded_paths else kept


def read_files(paths: DataFrame) -> DataFrame:
    """(path, text, content) of files by name (path), read where the rows are used; bytes that are no UTF-8 become replacement marks in the text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, READ_AT_ONCE):
                own = b.column(0).slice(k, READ_AT_ONCE)
                data = [_content(p) for p in own.to_pylist()]
                yield pa.RecordBatch.from_arrays([own, pa.array([d.decode(errors="replace") for d in data], pa.string()), pa.array(data, pa.binary())], names=["path", "text", "content"])

    return paths.select("path").mapInArrow(read, "path string, text string, content binary")


def local_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, text, content) of files by name."""
    return read_files(spark.createDataFrame([(p,) for p in paths], "path string"))


def _remote(path: str):
    """The file system of a URI and the path in it; nothing for local paths."""
    if not re.match(r"[a-z][a-z0-9+.-]*://", path) or path.startswith("file://"):
        return None
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _content(path: str) -> bytes:
    found = _remote(path)
    if found is None:
        return Path(path.removeprefix("file://")).read_bytes()
    with found[0].open_input_stream(found[1]) as f:
        return f.read()


def _lines(path: str) -> Iterator[str]:
    """The lines of a UTF-8 file, one at a time."""
    found = _remote(path)
    with open(path.removeprefix("file://"), "rb") if found is None else found[0].open_input_file(found[1]) as f:
        for line in io.BufferedReader(f) if found else f:
            if line.strip():
                yield line.decode()


def _entries(folder: str) -> list[tuple[str, str, int]]:
    """(name, kind, bytes) of what lies in a folder, by name; kinds are folder, file, and other for links and the rest."""
    found = _remote(folder)
    if found is None:
        out = []
        with os.scandir(folder.removeprefix("file://")) as entries:
            for e in entries:
                kind = "other" if e.is_symlink() else "folder" if e.is_dir() else "file" if e.is_file() else "other"
                out.append((e.name, kind, e.stat().st_size if kind == "file" else 0))
        return sorted(out)
    from pyarrow import fs

    kinds = {fs.FileType.Directory: "folder", fs.FileType.File: "file"}
    return sorted((i.base_name, kinds.get(i.type, "other"), i.size or 0) for i in found[0].get_file_info(fs.FileSelector(found[1])))


@dataclass(frozen=True)
class Outer:
    """An ignore file above a walk: the walk's root relative to its folder, and its text."""

    below: str
    name: str
    text: str


def walk(spark: SparkSession, folder: str, git: bool = True, outer: tuple[Outer, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The files below a folder, (path, bytes), and the folders that were opened, (path): a round of tasks for each depth.

    Ignored folders, links, and what ignore files take out are cut off before they are opened: a folder's rules go along with its
    children. .gitignore counts where ``git`` says so. Tasks open folders by path, so the store must be where tasks run.
    """
    base, names = folder.rstrip("/"), IGNORE_FILES if git else IGNORE_FILES[1:]

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = [(o.below, ignore_rules([(o.name, o.text)])) for o in outer]
        for b in batches:
            rows = []
            for path, carried in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                inside = path[len(base) :].strip("/")
                entries = _entries(path)
                known = json.loads(carried) + [[f"{inside}/{n}".strip("/"), _content(f"{path}/{n}").decode(errors="replace")] for n, kind, _ in entries if kind == "file" and n in names]
                rules = ignore_rules([tuple(x) for x in known])
                rows.append(("opened", path, 0, None))
                for n, kind, size in entries:
                    own = f"{inside}/{n}".strip("/")
                    is_folder = kind == "folder"
                    if kind == "other" or (is_folder and n in IGNORED_DIRECTORIES) or takes_out(rules, own, is_folder) or any(takes_out(r, f"{below}/{own}".strip("/"), is_folder) for below, r in above):
                        continue
                    rows.append((kind, f"{path}/{n}", size, json.dumps(known) if is_folder else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.string()))], names=["kind", "path", "bytes", "rules"])

    steps, found = Steps(spark), []
    # the root itself may lie in a folder that rules above it take out
    cut = any(takes_out(ignore_rules([(o.name, o.text)]), "/".join(o.below.split("/")[:n]), True) for o in outer for n in range(1, len(o.below.split("/")) + 1) if o.below)
    frontier = spark.createDataFrame([] if cut else [(base or "/", "[]")], "path string, rules string")
    while True:
        done = steps.write(frontier.repartition("path").mapInArrow(opened, "kind string, path string, bytes long, rules string"))
        found.append(done)
        frontier = done.where("kind = 'folder'").select("path", "rules")
        if frontier.isEmpty():
            break
    rows = found[0]
    for d in found[1:]:
        rows = rows.union(d)
    return rows.where("kind = 'file'").select("path", "bytes"), rows.where("kind = 'opened'").select("path")


@dataclass(frozen=True)
class IgnoreRule:
    """A line of an ignore file: a pattern for paths relative to the root, and whether it takes a path out or back in."""

    pattern: str
    negated: bool
    folders_only: bool


def _ignore_pattern(line: str) -> str:
    """The part of a path below the ignore file's folder that a pattern matches."""
    body = line.strip("/")
    anywhere = "/" not in body and not line.startswith("/")
    out, i = "(?:.*/)?" if anywhere else "", 0
    while i < len(body):
        c, rest = body[i], body[i:]
        if rest.startswith("**/"):
            out, i = out + "(?:.*/)?", i + 3
        elif rest == "**":
            out, i = out + ".+", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := body.find("]", i + 2)) > 0:
            inside = body[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out, i = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]", end + 1
        else:
            step = 2 if c == "\\" and i + 1 < len(body) else 1
            out, i = out + re.escape(body[i + step - 1]), i + step
    return out


def ignore_rules(files: list[tuple[str, str]]) -> list[IgnoreRule]:
    """The rules of ignore files (normalised path, text), weakest first: .gitignore before .ignore, outer folders before inner."""
    rules = []
    for path, text in sorted(files, key=lambda f: (IGNORE_FILES.index(os.path.basename(f[0])), f[0].count("/"), f[0])):
        folder = os.path.dirname(path)
        for raw in text.splitlines():
            line = raw if raw.endswith("\\ ") else raw.rstrip()
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            line = line[negated:]
            base = re.escape(folder) + "/" if folder else ""
            rules.append(IgnoreRule(f"^{base}{_ignore_pattern(line)}$", negated, line.endswith("/")))
    return rules


def ignored_by(path: Column, rules: list[IgnoreRule]) -> Column:
    """Whether rules take out a file or a folder that it lies in; of several that match one of them the strongest decides."""
    if not rules:
        return F.lit(False)
    parts = path_parts(path)
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("p"), (n < F.size(parts)).alias("folder")))

    def out(step: Column) -> Column:
        verdict = F.lit(False)
        for r in rules:
            hit = step.p.rlike(r.pattern) & (step.folder if r.folders_only else F.lit(True))
            verdict = F.when(hit, F.lit(not r.negated)).otherwise(verdict)
        return verdict

    return F.when(F.size(parts) > 0, F.exists(steps, out)).otherwise(F.lit(False))


def takes_out(rules: list[IgnoreRule], path: str, folder: bool) -> bool:
    """Whether rules take out a path as it stands, its folders not looked at; the last that matches decides."""
    hit = [r for r in rules if (folder or not r.folders_only) and re.match(r.pattern, path)]
    return bool(hit) and not hit[-1].negated


def in_git(folder: Path) -> bool:
    """Whether a local folder belongs to a git work tree."""
    return any((p / ".git").exists() for p in (folder, *folder.parents))
