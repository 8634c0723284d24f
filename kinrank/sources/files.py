"""A file tree as a table, hidden names included, by a partitioned Python data source.

Spark's own file sources skip names that start with '_' or '.'; this one lists
folders itself.  The driver lists only as many leading folders as it takes to
have enough pieces of work; tasks list the folders below and read the files.
The root is a path or URI of any file system that pyarrow opens, shared by all
machines.  Bytes that are not UTF-8 become U+FFFD; a file that cannot be read has
null content; links to nowhere and other special files are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.similarity import ship_by_value

PIECES = 64                  # of the listing, at least, if there are as many folders
FLAT = 5000                  # files of one folder that a task reads


class Piece(InputPartition):
    """Folders to be walked, or every `of`-th file of one folder (from number `part`) without those below."""

    def __init__(self, folders: list[str], walk: bool, part: int = 0, of: int = 1):
        super().__init__(None)
        self.folders, self.walk, self.part, self.of = folders, walk, part, of


class TreeReader(DataSourceReader):
    def __init__(self, root: str, pieces: int):
        self.root, self.pieces = root, pieces

    def _open(self):
        from pyarrow import fs
        system, base = fs.FileSystem.from_uri(self.root)
        return fs, system, base.rstrip("/")

    def partitions(self):
        fs, system, base = self._open()
        out, level = [], [base]
        while level and len(level) < self.pieces:              # one more level of folders
            below = []
            for folder in level:
                infos = system.get_file_info(fs.FileSelector(folder))
                files = sum(i.type == fs.FileType.File for i in infos)
                below += sorted(i.path for i in infos if i.type == fs.FileType.Directory)
                of = -(-files // FLAT)
                out += [Piece([folder], False, part, of) for part in range(of)]
            level = below
        shares = [level[i::self.pieces] for i in range(self.pieces)]
        return out + [Piece(share, True) for share in shares if share]

    def read(self, piece):
        from zlib import crc32
        fs, system, base = self._open()
        for folder in piece.folders:
            for info in system.get_file_info(fs.FileSelector(folder, recursive=piece.walk)):
                if info.type != fs.FileType.File or crc32(info.path.encode("utf-8", "surrogateescape")) % piece.of != piece.part:
                    continue
                try:
                    with system.open_input_stream(info.path) as f:
                        content = f.read().decode("utf-8", "replace")
                except OSError:
                    content = None
                yield info.path[len(base) + 1:], info.mtime, info.size, content


class FileTree(DataSource):
    """``spark.read.format("kinrank_files").option("pieces", 64).load(root)``."""

    @classmethod
    def name(cls):
        return "kinrank_files"

    def schema(self):
        return "path string, mtime timestamp, length bigint, content string"

    def reader(self, schema):
        return TreeReader(self.options["path"], int(self.options.get("pieces", PIECES)))


def read_tree(spark: SparkSession, root: str, pieces: int = PIECES) -> DataFrame:
    """(path, mtime, length, content) of every regular file below `root`, with paths relative to it."""
    ship_by_value(__name__)
    spark.dataSource.register(FileTree)
    return spark.read.format("kinrank_files").option("pieces", pieces).load(root)
