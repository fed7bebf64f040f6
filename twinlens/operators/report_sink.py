"""Reports of any size: sections written by tasks as part files in report order, under a manifest that is put in place at once.

A report is a folder. ``manifest.json`` names the version it stands for, the members that aren't lists of rows, and each section's
files with their rows, in order; a version's files lie in ``v-.../section=<name>``, one JSON line a row with its place. A new version is
written beside the old one, and becomes the report when its manifest replaces the old one's in one step of the file system: a run that fails
before leaves the report as it was. No row passes through the driver.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import OperationalError
from ..functions.values import MATCH_KINDS, NO_POSITION
from .report import SECTIONS, diagnostic_json, link_documents, result_documents

MANIFEST = "manifest.json"
#: The place of a row in its section; all that reports sort by.
ORDER = "struct<path:string,line:bigint,column:bigint,kind:int,code:string,message:string,fingerprint:string,tie:bigint>"
#: Files of a manifest that are sent to all tasks; more are dealt.
FEW_FILES = 50_000
_HEAD = '{"place":'
_ENTRY = ',"entry":'


def _order(path: Column, *rest: Column) -> Column:
    names = [x.split(":")[0] for x in ORDER[7:-1].split(",")]
    own = [path, *rest, *[F.lit(None)] * (len(names) - 1 - len(rest))]
    return F.struct(*(c.alias(n) for n, c in zip(names, own, strict=True))).cast(ORDER)


def lint_rows(links: DataFrame) -> DataFrame:
    """(section, order, json) of a lint report's lists, in one pass over the links: both runs' diagnostics and the links by bucket."""
    far, own, match = F.lit(NO_POSITION), F.coalesce("b", "c"), F.col("bucket") == "match"
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, MATCH_KINDS)), F.col("kind")), F.lit(0))
    place = lambda d: (F.coalesce(d["start_line"], far), F.coalesce(d["start_column"], far))
    link = F.struct(
        F.col("section"), _order(F.col("path"), *place(own), kind, F.when(~match, own["code"]), F.when(~match, own["message"]), own["fingerprint"], own["tie"]).alias("order"), F.col("json"),
    )
    run = lambda name, side: F.struct(
        F.lit(f"{name}.diagnostics").alias("section"), _order(F.col("path"), *place(F.col(side)), F.lit(0), *(F.col(side)[c] for c in ("code", "message", "fingerprint", "tie"))).alias("order"), F.to_json(diagnostic_json(side)).alias("json"),
    )
    both = link_documents(links, "bucket", "kind", "b", "c")
    return both.select(F.inline(F.array(link, run("baseline", "b"), run("candidate", "c")))).where("json IS NOT NULL")


def format_rows(results: DataFrame) -> DataFrame:
    """(section, order, json) of a format report's files."""
    return result_documents(results).select(F.lit("files").alias("section"), _order(F.col("path")).alias("order"), "json")


LINT_SECTIONS = ["baseline.diagnostics", "candidate.diagnostics", *SECTIONS.values()]
FORMAT_SECTIONS = ["files"]


def tables_of(document: dict, prefix: str = "") -> dict[str, DataFrame]:
    """The tables of a document by their dotted names."""
    out: dict[str, DataFrame] = {}
    for k, v in document.items():
        if isinstance(v, DataFrame):
            out[prefix + k] = v
        elif isinstance(v, dict):
            out |= tables_of(v, f"{prefix}{k}.")
    return out


def head_of(document: dict) -> dict:
    """A document without its tables."""
    return {k: head_of(v) if isinstance(v, dict) else v for k, v in document.items() if not isinstance(v, DataFrame)}


def write_document(spark: SparkSession, path: str, document: dict, rows: DataFrame, sections: list[str]) -> dict:
    """Write a report document; ``rows`` hold the tables of ``sections``, the document's other tables (json, sorted) are numbered as they come."""
    names = list(sections)
    for name, table in tables_of(document).items():
        if name not in sections:
            names.append(name)
            own = _order(F.lit(None), F.col("n"))
            rows = rows.unionByName(table.toDF("json").withColumn("n", F.monotonically_increasing_id()).select(F.lit(name).alias("section"), own.alias("order"), "json"))
    return write(spark, path, head_of(document), rows, names)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write(spark: SparkSession, path: str, head: dict, rows: DataFrame, sections: list[str]) -> dict:
    """Replace the report at ``path`` by ``head`` and ``rows`` (section, order, json); gives the manifest.

    Sections are those listed, empty ones too; rows of others raise. ``json`` holds no line ends, as compact JSON does.
    """
    version = f"v-{uuid.uuid4().hex}"
    number = F.coalesce(F.array_position(F.array(*map(F.lit, sections)), F.col("section")), F.lit(0).cast("long"))
    known = F.when(number > 0, number).otherwise(F.raise_error(F.concat(F.lit("no such section: "), F.coalesce("section", F.lit("none")))).cast("long"))
    # ranges keep the order over files; a task's rows are numbered in order, and all numbers rise from task to task
    placed = rows.withColumn("number", known).orderBy("number", "order").withColumn("place", F.monotonically_increasing_id())
    line = F.concat(F.lit(_HEAD), F.col("place").cast("string"), F.lit(_ENTRY), F.col("json"), F.lit("}"))
    folder = f"{path.rstrip('/')}/{version}"
    try:
        placed.sortWithinPartitions("section", "place").select("section", line.alias("value")).write.partitionBy("section").text(folder)
        listed = _listed(spark, folder)
        manifest = {"version": version, "head": head, "sections": []}
        for name in sections:
            files, n = sorted((r["place"], r["file"], r["rows"]) for r in listed if r["section"] == name), 0
            own = []
            for place, file, count in files:
                own.append({"file": file, "rows": count, "first": n, "place": place})
                n += count
            manifest["sections"].append({"name": name, "rows": n, "files": own})
        _replace(spark, path, json.dumps(manifest, ensure_ascii=False))
    except Exception:
        _drop(spark, folder)
        raise
    for old in _versions(spark, path):
        if old != version:
            _drop(spark, f"{path.rstrip('/')}/{old}")
    return manifest


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """(section, file, place, value) of a version's files."""
    rows = spark.read.schema("value string, section string").text(folder)
    place = F.substring_index(F.substring("value", len(_HEAD) + 1, 20), ",", 1).cast("long")
    return rows.select("section", F.col("_metadata.file_name").alias("file"), place.alias("place"), "value")


def _listed(spark: SparkSession, folder: str) -> list:
    """A row a file: its section, name, rows and least place."""
    p, fs = _fs(spark, folder)
    if not any(s.isDirectory() for s in fs.listStatus(p)):  # a report without rows has no files
        return []
    return _lines(spark, folder).groupBy("section", "file").agg(F.count("*").alias("rows"), F.min("place").alias("place")).collect()


def _replace(spark: SparkSession, path: str, text: str) -> None:
    jvm, (final, fs) = spark._jvm, _fs(spark, f"{path.rstrip('/')}/{MANIFEST}")
    staged = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/.{MANIFEST}.{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    out.write(bytearray(text.encode()))
    out.close()
    kinds = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    kinds[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    where = fs.makeQualified(final)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(staged), where, kinds)


def _versions(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName().startswith("v-")]


def _drop(spark: SparkSession, folder: str) -> None:
    p, fs = _fs(spark, folder)
    fs.delete(p, True)


def manifest_of(spark: SparkSession, path: str) -> dict:
    where = f"{path.rstrip('/')}/{MANIFEST}"
    p, fs = _fs(spark, where)
    if not fs.exists(p):
        raise OperationalError(f"there is no report at {path}")
    return json.loads(spark.read.option("wholetext", True).text(where).first()[0])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(section, n, json): the rows of the report at ``path``, ``n`` their place in the section from 0."""
    manifest = manifest_of(spark, path)
    files = [(s["name"], f["file"], f["first"], f["place"]) for s in manifest["sections"] for f in s["files"]]
    if not files:
        return spark.createDataFrame([], "section string, n long, json string")
    table = spark.createDataFrame(files, "section string, file string, first long, least long")
    rows = _lines(spark, f"{path.rstrip('/')}/{manifest['version']}")
    # a section's rows of one file follow each other, so their places do
    joined = rows.join(F.broadcast(table) if len(files) <= FEW_FILES else table, ["section", "file"])
    body = F.substring("value", F.length(F.col("place").cast("string")) + len(_HEAD) + len(_ENTRY) + 1, F.length("value"))
    return joined.select("section", (F.col("first") + F.col("place") - F.col("least")).alias("n"), F.left(body, F.length(body) - 1).alias("json"))
