"""A source of segments and a sink of masked files, for spark.read.format and df.write.format.

Both reach files through a store's address (file:, hdfs:, s3:, gs: ... as pyarrow knows them), so executors need no folder of
their own. ``register(spark)`` makes them known to a session.

``segment_nodes`` reads the text nodes of all files below a path. Its partitions are planned by size: small files lie together,
a large archive is cut at its parts (sheets, slides, sections), of which each task reads only its own. The options extensions and
matching (a pattern of paths) are applied while files are listed, so files that they leave out are never opened. They are
options and no pushed filters, since Spark keeps what was planned for one pushed filter for later reads of the same DataFrame.

``masked_files`` writes rows (path, name, content). Each attempt of a task writes into a folder of its own below the target;
only when all tasks have ended are the files of the attempts that count moved to their places, and then _SUCCESS is
written. So a task that fails or runs twice leaves nothing that a reader sees; at most, where one outlives the end of a failed
write, a folder whose name begins with _staging, which no reader lists.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from veilspark.functions import fixed
from veilspark.sources.files import ARCHIVES, archive_nodes, marked, nodes_of, opened, text_parts
from veilspark.sources.sinks import write_masked
from veilspark.stored import stored

#: Bytes of files in a partition, also the size from which an archive is cut at its parts; nodes of a part that ``seq`` leaves room for.
TARGET, ROOM = 32 * 1024 * 1024, 1 << 32
_READABLE = (".txt", ".csv", *ARCHIVES)
_STAGING = "_staging-"


def _store(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.partition("/")[0] else (fs.LocalFileSystem(), path)


def _extension(path: str) -> str:
    return posixpath.splitext(path)[1].lower()


def _listed(store, root: str) -> Iterator[tuple[str, int]]:
    """(path, size) of files, in order; names that begin with _ or . are not data."""
    from pyarrow import fs

    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
    for f in sorted(found, key=lambda f: f.path):
        inner = f.path[len(root) :].strip("/").split("/") if f is not info else []
        if f.type == fs.FileType.File and not any(x[:1] in ("_", ".") for x in inner):
            yield f.path, f.size


@dataclass
class Work(InputPartition):
    """(path, first seq, parts or None for all, whether the rest of the archive belongs to it) of each file or piece of one."""

    pieces: list[tuple[str, int, list[str] | None, bool]]


class NodeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.target = options["path"], int(options.get("targetbytes", TARGET))
        self.strict = options.get("unknown", "error") == "error"
        self.extensions = {x.strip().lower() for x in options.get("extensions", "").split(",") if x.strip()}
        self.matching = options.get("matching", "")

    def partitions(self) -> list[Work]:
        store, root = _store(self.root)
        out, held, size = [], [], 0

        def add(piece, n):
            nonlocal held, size
            if held and size + n > self.target:
                out.append(Work(held))
                held, size = [], 0
            held.append(piece)
            size += n

        for path, n in _listed(store, root):
            ext = _extension(path)
            if (self.extensions and ext not in self.extensions) or not re.search(self.matching, path):
                continue
            if ext not in _READABLE:
                if self.strict:
                    raise ValueError(f"no reader for {path}")
                continue
            if n <= self.target or ext not in ARCHIVES:
                add((path, 0, None, True), n)
                continue
            with store.open_input_file(path) as f, opened(f) as z:
                for i, part in enumerate(text_parts(ext, z)):
                    add((path, i * ROOM, [part], False), z.getinfo(part).compress_size)
                add((path, (i + 1) * ROOM, [], True), 0)
        return [*out, Work(held)] if held or not out else out  # without any partition Spark would hand out one of its own

    def read(self, partition: Work) -> Iterator[tuple]:
        store, _ = _store(self.root)
        for path, first, parts, rest in partition.pieces:
            ext = _extension(path)
            with store.open_input_file(path) as f:
                if ext in ARCHIVES:
                    with opened(f) as z:
                        nodes = archive_nodes(z, ext, parts, rest)
                else:
                    nodes = nodes_of(ext, f.read(), {})
            for i, (seg, text, sheet, row, col) in enumerate(nodes):
                yield path, ext, first + i, seg, text, sheet, row, col


class SegmentNodes(DataSource):
    """Options: extensions, a list with commas; matching, a pattern of paths; targetBytes for a partition; unknown=skip leaves out files of other formats, which else are an error."""

    @classmethod
    def name(cls) -> str:
        return "segment_nodes"

    def schema(self) -> str:
        return "path string, ext string, seq long, seg_id string, text string, sheet string, row int, col int"

    def reader(self, schema) -> NodeReader:
        return NodeReader({k.lower(): v for k, v in self.options.items()})


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    files: int


class FileWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.root, self.below, self.overwrite = options["path"].rstrip("/"), options.get("below"), overwrite
        self.staging = f"{_STAGING}{uuid.uuid4().hex}"

    def _place(self, path: str, name: str) -> str:
        """Where a file goes under the target: its folders below the one given are kept, else only its name."""
        if self.below is None:
            return name
        base = self.below.rstrip("/") + "/"
        if not path.startswith(base):
            raise ValueError(f"{path} does not lie below {base}")
        inner = posixpath.normpath(posixpath.join(posixpath.dirname(path[len(base) :]), name))
        if inner.startswith(("..", "/")):
            raise ValueError(f"{path} leads out of the target")
        return inner

    def write(self, iterator: Iterator) -> Attempt:
        store, root = _store(self.root)
        folder, n, made = f"{root}/{self.staging}/{uuid.uuid4().hex}", 0, set()
        for row in iterator:
            place = self._place(row["path"], row["name"])
            if place in made:
                raise ValueError(f"two files for {place}; give the option below to keep their folders")
            made.add(place)
            target = f"{folder}/{place}"
            store.create_dir(posixpath.dirname(target), recursive=True)
            with store.open_output_stream(target, compression=None) as out:
                out.write(bytes(row["content"]))
            n += 1
        return Attempt(folder, n)

    def commit(self, messages: list[Attempt | None]) -> None:
        from pyarrow import fs

        store, root = _store(self.root)
        moves: dict[str, str] = {}
        for m in messages:
            if m is not None and m.files:
                for f in store.get_file_info(fs.FileSelector(m.folder, recursive=True)):
                    if f.type == fs.FileType.File:
                        place = f.path[f.path.index(m.folder) + len(m.folder) + 1 :]
                        if place in moves:
                            raise ValueError(f"two files for {place}; give the option below to keep their folders")
                        moves[place] = f.path
        there = [p for p in moves if store.get_file_info(f"{root}/{p}").type != fs.FileType.NotFound]
        if there and not self.overwrite:
            raise FileExistsError(f"{there[0]} and {len(there) - 1} more are there; use mode overwrite to replace them")

        def move(place: str) -> None:
            store.create_dir(posixpath.dirname(f"{root}/{place}"), recursive=True)
            if place in replaced:
                store.delete_file(f"{root}/{place}")
            store.move(moves[place], f"{root}/{place}")

        replaced = set(there)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(move, moves))
        self._drop()
        with store.open_output_stream(f"{root}/_SUCCESS", compression=None):
            pass

    def abort(self, messages: list[Attempt | None]) -> None:
        self._drop()

    def _drop(self) -> None:
        from pyarrow import fs

        store, root = _store(self.root)
        if store.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.staging}")


class MaskedFiles(DataSource):
    """Mode append writes files beside those that are there, and fails before anything is moved where one would be replaced; mode
    overwrite replaces files of the same name and leaves others. The option below keeps the folders of paths below it."""

    @classmethod
    def name(cls) -> str:
        return "masked_files"

    def schema(self) -> str:
        return "path string, name string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    """Makes ``segment_nodes`` and ``masked_files`` known to the session."""
    spark.dataSource.register(SegmentNodes)
    spark.dataSource.register(MaskedFiles)


def load_segments(spark: SparkSession, path: str, extensions: tuple[str, ...] = (), **options) -> DataFrame:
    """What ``files.read_segments`` gives, for all files below a path, or those of some extensions: each is parsed once, and large
    archives by several tasks."""
    register(spark)
    return marked(stored(spark.read.format("segment_nodes").options(extensions=",".join(extensions), **options).load(path)))


def save_masked(files: DataFrame, segments: DataFrame, path: str, mode: str = "append", below: str | None = None) -> None:
    """``sinks.write_masked`` into files below a path, with commit."""
    register(files.sparkSession)
    writer = write_masked(files, segments).write.format("masked_files").mode(mode)
    (writer.option("below", below) if below is not None else writer).save(path)


def supported(path: str) -> bool:
    """Whether ``segment_nodes`` reads a file of this name; other formats of ``fixed.EXTENSIONS`` need a reader of the caller's."""
    return _extension(path) in _READABLE and _extension(path) in fixed.EXTENSIONS
