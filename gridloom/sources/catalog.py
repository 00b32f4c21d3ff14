"""Workbook catalogue over folders; incremental scans by file version."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that are never looked into, and default limits.
SKIPPED_FOLDERS = (".git", "node_modules", "__pycache__", ".venv", "venv", ".cache", "site-packages")
LIST_LIMIT = 200


def workbook_files(files: DataFrame, roots: list[str] | str, suffix: str = ".xlsx") -> DataFrame:
    """The files of a listing (column path) that count as workbooks; adds ``_rel``, the path below its root.

    Any case of the suffix counts; lock copies (``~$``) and files in hidden or noisy folders do not. Spark's file listing
    itself leaves out names that start with ``_`` or a dot.
    """
    relative = F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?", "")
    for root in [roots] if isinstance(roots, str) else roots:
        base = re.sub(r"^[a-z0-9]+:(//[^/]*)?", "", root).rstrip("/") + "/"
        relative = F.when(F.startswith(relative, F.lit(base)), F.substr(relative, F.lit(len(base) + 1))).otherwise(relative)
    name = F.substring_index("path", "/", -1)
    noisy = "|".join(re.escape(s) for s in SKIPPED_FOLDERS)
    return files.withColumn("_rel", relative).where(
        F.lower(name).endswith(suffix) & ~name.startswith("~$") & ~F.col("_rel").rlike(rf"(^|/)(\.[^/]*|{noisy})/"))


def glob_pattern(glob: str) -> str:
    """A file glob (``*``, ``?``, ``[..]``; ``*`` also crosses folders) as an anchored regex."""
    out, i = "", 0
    while i < len(glob):
        ch = glob[i]
        close = glob.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif close > 0:
            body = glob[i + 1:close]
            out += "[" + ("^" + body[1:] if body.startswith("!") else body).replace("\\", "\\\\") + "]"
            i = close
        else:
            out += re.escape(ch)
        i += 1
    return f"(?s)^{out}$"


def list_workbooks(spark: SparkSession, roots: list[str] | str, glob: str | None = None,
                   limit: int | None = LIST_LIMIT, suffix: str = ".xlsx") -> DataFrame:
    """(path, size, modified), newest first. File contents are not read.

    All matches are sorted before the limit, so the newest files are never missed.
    """
    roots = [roots] if isinstance(roots, str) else list(roots)
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    )
    files, name = workbook_files(files, roots, suffix), F.substring_index("path", "/", -1)
    if glob:
        pattern = glob_pattern(glob)
        files = files.where(F.col("_rel").rlike(pattern) | name.rlike(pattern))
    files = files.drop("_rel").dropDuplicates(["path"]).orderBy(F.desc("modified"), "path")
    return files if limit is None else files.limit(limit)


def changed_files(catalog: DataFrame, seen: DataFrame) -> DataFrame:
    """Files whose (path, size, modified) version has not been scanned before."""
    return catalog.join(seen, ["path", "size", "modified"], "left_anti")
