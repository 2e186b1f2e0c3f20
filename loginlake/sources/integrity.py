"""Log files with their state, as a data source whose tasks open the files by themselves.

A gzip file is inflated to its end in small pieces, so its size sets neither a task's memory nor what is
checked.  Other files have no end mark; opening them is all there is to check.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import filesystem

PIECE_BYTES = 1 << 20
TASK_BYTES = 64 << 20  # small files share a task up to so many bytes
WHOLE, DAMAGED, UNREADABLE = "whole", "damaged", "unreadable"


def gzip_is_whole(pieces: Iterable[bytes]) -> bool:
    """Whether gzip data, given in pieces, ends with a complete member; members may follow each other,
    then zeros may.  No data at all is a file without lines."""
    member, ended, some = zlib.decompressobj(wbits=31), False, False
    try:
        for piece in pieces:
            some = some or bool(piece)
            while piece:
                if ended and piece.strip(b"\0"):
                    member, ended = zlib.decompressobj(wbits=31), False
                    piece = piece.lstrip(b"\0")
                elif ended:
                    break
                # bounded output, as a piece of zeros can inflate to a thousand times its size
                full = True
                while (piece or full) and not member.eof:
                    full = len(member.decompress(piece, PIECE_BYTES)) == PIECE_BYTES
                    piece = member.unconsumed_tail
                piece, ended = member.unused_data, member.eof
    except zlib.error:
        return False
    return ended or not some


def _pieces(stream) -> Iterator[bytes]:
    while piece := stream.read(PIECE_BYTES):
        yield piece


def file_state(files: fs.FileSystem, path: str) -> str:
    try:
        with files.open_input_stream(path, compression=None) as stream:
            if not path.endswith(".gz"):
                stream.read(1)
                return WHOLE
            return WHOLE if gzip_is_whole(_pieces(stream)) else DAMAGED
    except OSError:
        return UNREADABLE


def uri_text(path: str) -> str:
    """A path as Spark's file metadata shows it: characters that no URI may have are escaped."""
    return re.sub(r'[\x00-\x20"<>#%?\[\\\]^`{|}\x7f]', lambda c: f"%{ord(c[0]):02X}", path)


@dataclass
class Files(InputPartition):
    found: list[tuple[str, int]]


class LogFiles(DataSource):
    """Options: path (a qualified folder), log_file, recursive."""

    @classmethod
    def name(cls) -> str:
        return "log_files"

    def schema(self) -> str:
        return "file_path string, file_name string, bytes bigint, state string"

    def reader(self, schema) -> DataSourceReader:
        return LogFilesReader(self.options["path"], self.options["log_file"], self.options["recursive"] == "true")


class LogFilesReader(DataSourceReader):
    def __init__(self, folder: str, log_file: str, recursive: bool):
        self.folder, self.log_file, self.recursive = folder, log_file, recursive

    def partitions(self) -> list[Files]:
        files, path = filesystem(self.folder)
        packs, size = [Files([])], 0
        for f in files.get_file_info(fs.FileSelector(path, recursive=self.recursive)):
            named = f.base_name == self.log_file or f.base_name.startswith(f"{self.log_file}.")
            if f.type == fs.FileType.Directory or not named:
                continue
            if packs[-1].found and size + f.size > TASK_BYTES:
                packs.append(Files([]))
                size = 0
            packs[-1].found.append((f.path, f.size))
            size += f.size
        return packs

    def read(self, partition: Files) -> Iterator[tuple]:
        files, path = filesystem(self.folder)
        prefix = self.folder.removesuffix(path)
        for found, size in partition.found:
            yield uri_text(prefix + found), found.rsplit("/", 1)[-1], size, file_state(files, found)
