"""One file a function, and histories rewritten at once.

``function_files`` is a writer of Spark's Python data sources: tasks write below a staging folder beside the target, each
attempt in a folder of its own; the driver moves what the successful attempts wrote when all are done.  A failed task leaves
no file, a task that ran twice leaves its files once, and a reader finds the old tree or the new one.  The target is a
folder that the driver and all executors see under one path.
"""

from __future__ import annotations

import contextlib
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from siltstone.functions import expressions as X


def function_file(path: Column, ident: Column) -> Column:
    """Where a function's code goes: folder/name-extension/scopes/name.extension of its source file."""
    ext = X.extension(path)
    folder = F.regexp_replace(path, r"(?<=[^/])\.([^./]*)$", "-$1")
    name = F.replace(F.replace(ident, F.lit("/"), F.lit("_")), F.lit("::"), F.lit("/"))
    return F.concat(folder, F.lit("/"), F.when(F.coalesce(ident, F.lit("")) == "", "_function").otherwise(name), F.lit("."), ext)


@dataclass
class _Attempt(WriterCommitMessage):
    """What a task wrote: its folder and the number of files in it."""

    folder: str
    files: int


def _local(path: str) -> str:
    for scheme in ("file://", "file:"):
        if path.startswith(scheme):
            return path[len(scheme) :]
    if "://" in path:
        raise ValueError(f"function_files writes to a mounted folder, not to {path}")
    return path


def _folders_below(top: str, place: str) -> None:
    """Make the folders of a place below top, but not top itself: it is gone when the write was given up."""
    for part in filter(None, place.split(os.sep)):
        top = os.path.join(top, part)
        with contextlib.suppress(FileExistsError):
            os.mkdir(top)


class FunctionFilesWriter(DataSourceWriter):
    """Rows (file, content); options: path, the target."""

    def __init__(self, path: str, overwrite: bool):
        self.target, self.overwrite = _local(path).rstrip("/"), overwrite
        self.staging = f"{self.target}.staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> _Attempt:
        folder, n = os.path.join(self.staging, uuid.uuid4().hex), 0
        os.makedirs(folder)
        for row in rows:
            name = os.path.normpath(row["file"] or "")
            if name in ("", ".") or os.path.isabs(name) or name.split(os.sep)[0] == "..":
                raise ValueError(f"not a file below the target: {row['file']!r}")
            at = os.path.join(folder, name)
            _folders_below(folder, os.path.dirname(name))
            with open(at, "x", encoding="utf-8", newline="") as f:  # two functions of one file name are an error
                f.write(row["content"] or "")
            n += 1
        return _Attempt(folder, n)

    def commit(self, messages: list[_Attempt | None]) -> None:
        """Build the whole tree beside the target, then exchange the two."""
        tree = os.path.join(self.staging, "tree")
        os.makedirs(tree, exist_ok=True)
        try:
            if not self.overwrite and os.path.isdir(self.target):
                shutil.copytree(self.target, tree, dirs_exist_ok=True, copy_function=os.link)
            for m in messages:
                if m is None or not m.files:
                    continue
                for folder, _, names in os.walk(m.folder):
                    to = os.path.join(tree, os.path.relpath(folder, m.folder))
                    os.makedirs(to, exist_ok=True)
                    for name in names:
                        if os.path.exists(at := os.path.join(to, name)):
                            raise ValueError(f"two functions have the file {os.path.relpath(at, tree)}")
                        os.rename(os.path.join(folder, name), at)
            old = f"{self.staging}.old"
            if os.path.isdir(self.target):
                os.rename(self.target, old)
            os.makedirs(os.path.dirname(self.target) or ".", exist_ok=True)
            os.rename(tree, self.target)
            shutil.rmtree(old, ignore_errors=True)
        finally:
            shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[_Attempt | None]) -> None:
        """Move the staging folder away first, so that tasks that still run find no place to write to."""
        gone = f"{self.staging}.gone"
        with contextlib.suppress(FileNotFoundError):
            os.rename(self.staging, gone)
        shutil.rmtree(gone, ignore_errors=True)


class FunctionFilesReader(DataSourceReader):
    """Rows (file, content): a task for each folder of source files; tasks list what is below."""

    def __init__(self, path: str):
        self.target = _local(path).rstrip("/")

    def partitions(self) -> list[InputPartition]:
        out = []
        for folder, names, files in os.walk(self.target):
            depth = os.path.relpath(folder, self.target).count(os.sep) + (folder != self.target)
            if depth >= 2:
                out.append(InputPartition((folder, True)))
                names.clear()
            elif files:
                out.append(InputPartition((folder, False)))
        return out or [InputPartition((self.target, False))]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        top, deep = partition.value
        for folder, names, files in os.walk(top):
            if not deep:
                names.clear()
            for name in sorted(files):
                at = os.path.join(folder, name)
                with open(at, encoding="utf-8", errors="replace", newline="") as f:
                    yield os.path.relpath(at, self.target), f.read()


class FunctionFiles(DataSource):
    """The data source ``function_files``."""

    @classmethod
    def name(cls) -> str:
        return "function_files"

    def schema(self) -> str:
        return "file string, content string"

    def reader(self, schema) -> FunctionFilesReader:
        return FunctionFilesReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> FunctionFilesWriter:
        return FunctionFilesWriter(self.options["path"], overwrite)


def write_function_files(functions: DataFrame, path: str, mode: str = "overwrite") -> None:
    """functions: (path, ident, content), each to its ``function_file`` below path.  'overwrite' replaces the tree, 'append'
    adds to it; a file that two functions would share is an error, and nothing changes."""
    functions.sparkSession.dataSource.register(FunctionFiles)
    rows = functions.select(function_file(F.col("path"), F.col("ident")).alias("file"), "content")
    rows.write.format("function_files").mode(mode).option("path", path).save()


def read_function_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of the tree, files by their place below path; names that Spark's own readers pass over are there too."""
    spark.dataSource.register(FunctionFiles)
    return spark.read.format("function_files").option("path", path).load()


def rewrite_history(records: DataFrame, path: str) -> int:
    """Replace the JSON lines below path by records in order, as ``workspace.history`` gives them: written
    beside path by Spark's committer, then exchanged by two renames, in any store that Spark writes to.  Without records
    nothing happens.  A failure in between puts the old lines back.  Returns the number of records."""
    spark = records.sparkSession
    n = records.count()
    if not n:
        return 0
    staged, old = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    order = ["first__f", "first__i"]
    columns = [c for c in records.columns if c not in order]
    records.orderBy(*order).select(F.to_json(F.struct(*columns)).alias("value")).write.text(staged)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    there = fs.exists(hadoop(path))
    if there and not fs.rename(hadoop(path), hadoop(old)):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(hadoop(staged), hadoop(path)):
        if there:
            fs.rename(hadoop(old), hadoop(path))
        raise OSError(f"{path} can't be replaced")
    if there:
        fs.delete(hadoop(old), True)
    return n


def archived_histories(spark: SparkSession, project: str, prefix: str = "analysis", name: str = "history.jsonl", apart: str = "") -> list[str]:
    """Histories of a project's current and archived workspaces, folders that begin with ``prefix``, in order of their names;
    the folder ``apart`` isn't one of them.  For ``workspace.history``, which merges them."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    root = hadoop(project)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = fs.globStatus(hadoop(f"{project.rstrip('/')}/{prefix}*/{name}")) or []
    paths = {s.getPath().getParent().getName(): s.getPath().toString() for s in found}
    return [path for folder, path in sorted(paths.items()) if folder != apart]
