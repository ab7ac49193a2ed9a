"""Dumps of JSON documents, gzipped or plain, read by structure instead of lines.

A document is an object that isn't inside another: dumps hold them one after another, or as one array, with
any white space between and inside them.  A document that can't be one (its brackets don't match, a line ends
inside a string, a value stands where none may) is left out, and reading goes on at the next line that
begins with an object and isn't indented deeper than the one where the broken document began.

A partition is a file.  gzip can't be entered in the middle, but a file of several members can at the
beginning of each: with ``members`` (for dumps whose members hold whole documents, such as files that were put
one behind the other) a partition is a range of ``splitBytes`` bytes and reads the members that begin there.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .shared import opened

CHUNK, SPLIT_BYTES, MAGIC = 1 << 20, 128 << 20, b"\x1f\x8b\x08"
#: A whole string, a bracket, or the quote of a string whose end isn't there.
_TOKEN = re.compile(rb'"[^"\\\n]*(?:\\.[^"\\\n]*)*"|[{}\[\]"]')
_LINE = re.compile(rb"\n([ \t]*)[,\[ \t]*\{")
_CLOSES = {ord("{"): ord("}"), ord("["): ord("]")}


def split_documents(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The documents of a stream.  A document is held whole, whatever its size; of the rest about a chunk."""
    buf, at, start, before, indent, closers, lost = b"", 0, 0, 0, 0, bytearray(), False
    for chunk in chain(chunks, (None,)):
        last, chunk = chunk is None, chunk or b""
        keep = at if lost or not closers else start
        buf, at, start, before = buf[keep:] + chunk, at - keep, start - keep, before - keep
        while True:
            if lost:
                line = next((m for m in _LINE.finditer(buf, at) if len(m[1]) <= indent), None)
                if line is None:
                    at = max(at, buf.rfind(b"\n"))
                    break
                at, lost = line.end(1), False
            token = _TOKEN.search(buf, at)
            if token is None:
                if not closers:  # the line's beginning stays, as its indentation counts
                    at = max(at, buf.rfind(b"\n"), len(buf) - CHUNK)
                elif last and (line := buf.find(b"\n", start)) >= 0:  # what was taken for a part may be whole
                    closers.clear()
                    at, lost = line, True
                    continue
                break
            kind, here = token[0][0], token.start()
            if not closers:
                if kind == 0x7B:
                    prefix = buf[buf.rfind(b"\n", 0, here) + 1 : here]
                    start, before, indent = here, token.end(), len(prefix) - len(prefix.lstrip(b" \t"))
                    closers.append(0x7D)
                elif token[0] == b'"' and b"\n" not in buf[here:]:
                    at = max(here, len(buf) - CHUNK)
                    break
                at = token.end()
                continue
            # what stands before a value: the mark that ends the gap, or the bracket that the gap follows
            mark = buf[before:here].rstrip()[-1:] or buf[before - 1 : before]
            if kind in _CLOSES:
                good = mark == b":" if closers[-1] == 0x7D else mark in (b",", b"[")
            elif kind == 0x22:
                good = mark in (b",", b":", b"[", b"{")
                if good and token[0] == b'"':  # without an end: yet, or in this line
                    if not last and buf.find(b"\n", here) < 0:
                        break
                    good = False
            else:
                good = kind == closers[-1]
            if not good:
                closers.clear()
                line = buf.find(b"\n", start)
                at, lost = (line if line >= 0 else len(buf)), True
                continue
            at = before = token.end()
            if kind in _CLOSES:
                closers.append(_CLOSES[kind])
            elif kind != 0x22:
                closers.pop()
                if not closers:
                    yield buf[start:at]


def _inflated(stream: BinaryIO, only_one: bool = False) -> Iterator[bytes]:
    """The text of a gzip stream, member by member; it ends where the stream is damaged."""
    engine, fed = zlib.decompressobj(31), b""
    while True:
        fed = fed or stream.read(CHUNK)
        if not fed:
            return
        try:
            out = engine.decompress(fed, CHUNK)
        except zlib.error:
            return
        fed = engine.unconsumed_tail or engine.unused_data
        if out:
            yield out
        if engine.eof:
            if only_one:
                return
            engine, fed = zlib.decompressobj(31), fed.lstrip(b"\0")


def _plain(stream: BinaryIO) -> Iterator[bytes]:
    while chunk := stream.read(CHUNK):
        yield chunk


def _members(stream: BinaryIO, begin: int, end: int) -> Iterator[int]:
    """Where members begin in a range: the magic number, followed by what can be inflated to the beginning of documents."""
    at = begin
    while at < end:
        stream.seek(at)
        block = stream.read(CHUNK + len(MAGIC) - 1)
        for m in re.finditer(re.escape(MAGIC), block[: min(CHUNK, end - at) + len(MAGIC) - 1]):
            stream.seek(at + m.start())
            try:
                head = zlib.decompressobj(31).decompress(stream.read(4096), 64)
            except zlib.error:
                continue
            if not head or head.lstrip()[:1] in (b"", b"{", b"[", b","):
                yield at + m.start()
        at += CHUNK


@dataclass
class _Range(InputPartition):
    """Bytes of a file; ``end`` is None for the whole of it."""

    path: str
    number: int
    begin: int = 0
    end: int | None = None


def _files(path: str) -> list[tuple[str, int]]:
    """Path and size of a file, or of all files below a folder whose names don't begin with ``_`` or a dot."""
    where, name = opened(path)
    info = where.get_file_info(name)
    prefix = path[: len(path) - len(name)] if path.endswith(name) else ""
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = where.get_file_info(fs.FileSelector(name, recursive=True))
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "_.")


class _DumpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.members = options["path"], options.get("members", "false").lower() == "true"
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[InputPartition]:
        ranges = [(p, a, min(a + self.split, n)) for p, n in _files(self.path) for a in range(0, n, self.split)] if self.members else [(p, 0, None) for p, _ in _files(self.path)]
        return [_Range(p, i, a, b) for i, (p, a, b) in enumerate(ranges)] or [_Range("", 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        if not partition.path:
            return
        where, name = opened(partition.path)
        with where.open_input_file(name) as stream:
            zipped = stream.read(len(MAGIC)) == MAGIC
            n = 0
            if partition.end is None or not zipped:
                if partition.begin:
                    return  # a plain file is one partition
                stream.seek(0)
                texts = [_inflated(stream) if zipped else _plain(stream)]
            else:
                texts = (self._member(stream, at) for at in _members(stream, partition.begin, partition.end))
            for text in texts:
                for document in split_documents(text):
                    yield (partition.number << 36) + n, document.decode("utf-8", "replace")
                    n += 1

    @staticmethod
    def _member(stream: BinaryIO, at: int) -> Iterator[bytes]:
        stream.seek(at)
        return _inflated(stream, only_one=True)


class DumpSource(DataSource):
    """``spark.read.format("documents_dump").load(path)``: seq (in the order of the dump) and json."""

    @classmethod
    def name(cls) -> str:
        return "documents_dump"

    def schema(self) -> str:
        return "seq bigint, json string"

    def reader(self, schema: StructType) -> _DumpReader:
        return _DumpReader(self.options)


def scan_dump(spark: SparkSession, path: str, members: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """seq and json of the documents of a dump: a file, or all files of a folder."""
    spark.dataSource.register(DumpSource)
    return spark.read.format(DumpSource.name()).option("members", str(members).lower()).option("splitBytes", str(split_bytes)).load(path)
