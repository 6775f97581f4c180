"""Corpora that are file trees: listing, include and exclude rules, hashes, content.

A tree is walked level by level: each job lists the folders of one level in its tasks, and what the
rules exclude is not entered. Hashes are made block by block, so no task holds a file for its hash.
Tasks reach the files by pyarrow's file systems; a link to a folder is not followed.
"""

from __future__ import annotations

import hashlib
import os
import posixpath
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import values as V
from ..session import bound_batches, broadcast_if_small, materialize, new_path

_BATCH_BYTES = 32 * 1024 * 1024
_BATCH_ROWS = 10_000
#: A file is hashed by blocks of so many bytes.
HASH_BLOCK = 4 * 1024 * 1024
_LISTED = "relpath string, path string, mtime timestamp, size bigint"


def glob_regex(pattern: str) -> str:
    """A path glob as an anchored regular expression; ``**`` spans directories."""
    parts = pattern.split("/")
    out = []
    for position, part in enumerate(parts):
        last = position == len(parts) - 1
        if part == "**":
            out.append(".+" if last else "(?:[^/]+/)*")
            continue
        piece, i = "", 0
        while i < len(part):
            c = part[i]
            close = part.find("]", i + 2) if c == "[" else -1
            if c == "*":
                piece += "[^/]*"
            elif c == "?":
                piece += "[^/]"
            elif close > 0:
                body = part[i + 1 : close].replace("\\", "\\\\")
                piece += "[" + ("^/" + body[1:] if body[0] == "!" else body) + "]"
                i = close
            else:
                piece += "\\" + c if not c.isalnum() and c.isascii() and c not in "_-" else c
            i += 1
        out.append(piece + ("" if last else "/"))
    return "(?s)^" + "".join(out) + r"\z"


def matches_globs(relpath: Column, patterns: list[str]) -> Column:
    found = F.lit(False)
    for pattern in patterns:
        found = found | relpath.rlike(glob_regex(pattern))
    return found


def match_globs(df: DataFrame, patterns: list[str] | None = None, path: str = "relpath") -> DataFrame:
    """Rows that match any pattern: one pass, so a path matched twice stays one row."""
    return df.filter(matches_globs(F.col(path), V.INCLUDE if patterns is None else patterns))


def apply_excludes(
    df: DataFrame,
    dirs: list[str] | None = None,
    files: list[str] | None = None,
    allow_prefixes: list[str] | None = None,
    path: str = "relpath",
) -> DataFrame:
    """Drop paths with an excluded component and excluded whole paths. Paths under an
    allowed prefix pass the component rule."""
    dirs = V.EXCLUDE_DIRS if dirs is None else dirs
    files = V.EXCLUDE_FILES if files is None else files
    allow_prefixes = V.ALLOW_PREFIXES if allow_prefixes is None else allow_prefixes
    relpath = F.col(path)
    keep = F.lit(True)
    if dirs:
        keep = ~F.arrays_overlap(F.split(relpath, "/"), F.array(*[F.lit(d) for d in dirs]))
        for prefix in allow_prefixes:
            keep = keep | (relpath == prefix) | relpath.startswith(prefix + "/")
    if files:
        keep = keep & ~relpath.isin(*files)
    return df.filter(keep)


def qualified(spark: SparkSession, root: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(path).toString()


def _under(relpath: Column, prefixes: list[str]) -> Column:
    """Folders on the way to an allowed prefix, or below one."""
    found = F.lit(False)
    for prefix in prefixes:
        found = found | (relpath == prefix) | relpath.startswith(prefix + "/") | F.lit(prefix).startswith(
            F.concat(relpath, F.lit("/"))
        )
    return found


class _FileSystems:
    """File system and path of a plain name; one file system per scheme and host in a task."""

    def __init__(self):
        self.held = {}

    def __call__(self, name: str):
        from pyarrow import fs

        place = urlsplit(name)
        key = (place.scheme, place.netloc)
        # the listing gives plain names, a URI wants them quoted
        uri = quote(name, safe="/:@")
        if key not in self.held:
            if name.startswith("file:/") and not name.startswith("file://"):
                uri = "file://" + uri[5:]
            self.held[key], path = fs.FileSystem.from_uri(uri)
            return self.held[key], path
        if place.scheme in ("", "file"):
            return self.held[key], name.removeprefix("file://").removeprefix("file:")
        return self.held[key], fs.FileSystem.from_uri(uri)[1]


def _entries(filesystem, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """Name, is a folder, microseconds, bytes of what lies in a folder; nothing if it is gone."""
    from pyarrow import fs

    if isinstance(filesystem, fs.LocalFileSystem):
        try:
            with os.scandir(folder) as inside:
                for entry in inside:
                    if entry.is_dir(follow_symlinks=False):
                        yield entry.name, True, 0, 0
                    elif entry.is_file():
                        stat = entry.stat()
                        yield entry.name, False, stat.st_mtime_ns // 1000, stat.st_size
        except FileNotFoundError:
            return
        return
    for info in filesystem.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if info.type == fs.FileType.Directory:
            yield info.base_name, True, 0, 0
        elif info.type == fs.FileType.File:
            yield info.base_name, False, info.mtime_ns // 1000, info.size


def _list_folders(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["relpath", "path", "is_folder", "mtime", "size"]
    file_system = _FileSystems()
    rows = []
    for frame in frames:
        for relpath, path in zip(frame["relpath"], frame["path"]):
            for name, is_folder, micros, size in _entries(*file_system(path)):
                below = f"{relpath}/{name}" if relpath else name
                rows.append((below, f"{path}/{name}", is_folder, micros, size))
                if len(rows) == _BATCH_ROWS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def scan_files(
    spark: SparkSession,
    root: str,
    include: list[str] | None = None,
    exclude_dirs: list[str] | None = None,
    exclude_files: list[str] | None = None,
    allow_prefixes: list[str] | None = None,
) -> DataFrame:
    """Listing of a file tree: relpath, path, mtime, size. Names may begin with any character."""
    include = V.INCLUDE if include is None else include
    dirs = V.EXCLUDE_DIRS if exclude_dirs is None else exclude_dirs
    allowed = V.ALLOW_PREFIXES if allow_prefixes is None else allow_prefixes
    folder = new_path(spark, "listing")
    tasks = spark.sparkContext.defaultParallelism
    level = spark.createDataFrame([("", qualified(spark, root).rstrip("/"))], "relpath string, path string")
    depth = 0
    while True:
        schema = "relpath string, path string, is_folder boolean, mtime bigint, size bigint"
        level.repartition(tasks).mapInPandas(_list_folders, schema).write.parquet(f"{folder}/depth={depth}")
        listed = spark.read.schema(schema).parquet(f"{folder}/depth={depth}")
        entered = listed.filter("is_folder")
        if dirs:
            name = F.element_at(F.split("relpath", "/"), -1)
            entered = entered.filter(~name.isin(*dirs) | _under(F.col("relpath"), allowed))
        level = entered.select("relpath", "path")
        if level.isEmpty():
            break
        depth += 1
    found = spark.read.schema(schema).parquet(*[f"{folder}/depth={d}" for d in range(depth + 1)])
    files = found.filter("not is_folder").select("relpath", "path", F.timestamp_micros("mtime").alias("mtime"), "size")
    return apply_excludes(match_globs(files, include), dirs, exclude_files, allowed)


def decode_text(df: DataFrame, content: str = "content", out: str = "text") -> DataFrame:
    return df.withColumn(out, S.decode_text(F.col(content)))


def _each_file(use: Callable, columns: list[str]):
    """A task function that opens the files of its rows one after the other. ``use`` gets the
    stream and returns a value and the bytes it holds. A file that has vanished since the listing
    gives no row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file_system = _FileSystems()
        for frame in frames:
            rows, held = [], 0
            for row in frame.itertuples(index=False):
                filesystem, path = file_system(row.path)
                try:
                    with filesystem.open_input_stream(path) as stream:
                        value, size = use(stream)
                except FileNotFoundError:
                    continue
                rows.append((row.relpath, row.path, row.mtime, row.size, value))
                held += size
                if held >= _BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return run


def _whole(stream) -> tuple[bytes, int]:
    content = stream.read()
    return content, len(content)


def block_hash(stream, block: int = HASH_BLOCK) -> tuple[str, int]:
    """SHA-256 of a stream, of which one block at a time is held."""
    digest = hashlib.sha256()
    while data := stream.read(block):
        digest.update(data)
    return digest.hexdigest(), 0


def _spread(files: DataFrame) -> DataFrame:
    """Listed files dealt over the tasks, whatever folder they were found in."""
    return files.select("relpath", "path", "mtime", "size").repartition(files.sparkSession.sparkContext.defaultParallelism)


def read_contents(files: DataFrame) -> DataFrame:
    """Contents of listed files (relpath, path, mtime, size): each task opens only the files
    in its rows, so the cost is that of the listed files and not of the tree."""
    run = _each_file(_whole, ["relpath", "path", "mtime", "size", "content"])
    return _spread(files).mapInPandas(run, _LISTED + ", content binary")


def hash_files(files: DataFrame) -> DataFrame:
    """Listed files with ``content_hash``, the hash of their bytes, read block by block."""
    run = _each_file(block_hash, ["relpath", "path", "mtime", "size", "content_hash"])
    return _spread(files).mapInPandas(run, _LISTED + ", content_hash string")


def corpus_from_files(listing: DataFrame) -> DataFrame:
    """A listing as a corpus, all files read; the hash is that of the raw bytes."""
    return read_contents(listing).select(
        "relpath",
        S.decode_text(F.col("content")).alias("text"),
        "mtime",
        "size",
        S.content_hash(F.col("content")).alias("content_hash"),
    )


@dataclass(frozen=True)
class FileCorpus:
    """A file tree as a corpus that is read only where an operator asks for a file."""

    listing: DataFrame

    def _listed(self, keys: DataFrame) -> DataFrame:
        return self.listing.join(broadcast_if_small(keys.select("relpath")), "relpath", "left_semi")

    def rows_of(self, keys: DataFrame) -> DataFrame:
        """Corpus rows of the paths in ``keys``; no other file is opened."""
        return corpus_from_files(self._listed(keys))

    def hashes_of(self, keys: DataFrame) -> DataFrame:
        """relpath, path, mtime, size, content_hash of these files, read block by block."""
        return hash_files(self._listed(keys))


def write_tree(docs: DataFrame, folder: str) -> None:
    """Write documents (relpath, text) as files below a folder. A file that exists is replaced."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file_system, made = _FileSystems(), set()
        for frame in frames:
            for relpath, text in zip(frame["relpath"], frame["text"]):
                filesystem, path = file_system(f"{folder}/{relpath}")
                parent = posixpath.dirname(path)
                if parent not in made:
                    filesystem.create_dir(parent, recursive=True)
                    made.add(parent)
                with filesystem.open_output_stream(path) as out:
                    out.write((text or "").encode())
            yield pd.DataFrame({"n": [len(frame)]})

    bound_batches(docs.sparkSession)
    folder = qualified(docs.sparkSession, folder)
    materialize(docs.select("relpath", "text").mapInPandas(run, "n bigint"), "tree")
