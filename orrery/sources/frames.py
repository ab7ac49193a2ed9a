"""A subscription as a streaming source whose frames can be read again.

What a subscription sends is gone once it is received, so frames are written to a log in a shared folder before their
offsets are known to Spark.  A batch that failed reads its frames from the log; so does a query that starts again after
the driver was lost, and frames that were received but not yet dealt out come first then.  A file of the
log is deleted when the batch with its last frame is committed.

Frames are admitted by number or age: a batch holds ``FLUSH_ROWS``, or what has come ``FLUSH_SECONDS`` after the first frame
that waits.  At most ``QUEUE_ROWS`` frames wait; beyond, the subscription isn't asked, so that it holds them back.
"""

from __future__ import annotations

import struct
import time
from collections import deque
from collections.abc import Callable, Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from .shared import opened

FLUSH_ROWS, FLUSH_SECONDS, QUEUE_ROWS, LONGEST_WAIT = 200, 1.0, 2000, 60.0
#: ``connect`` returns a function that gives the frames that have come; both may raise OSError.
Connect = Callable[[], Callable[[], list[bytes]]]


class FrameLog:
    """Frames by number, in files named by the first number and the one after the last."""

    def __init__(self, path: str):
        self.where, self.path = opened(path)
        self.where.create_dir(self.path, recursive=True)

    def _files(self) -> list[tuple[int, int, str]]:
        found = self.where.get_file_info(fs.FileSelector(self.path))
        parts = [(f.base_name.removesuffix(".frames").split("-"), f.path) for f in found if f.base_name.endswith(".frames")]
        return sorted((int(p[0]), int(p[1]), path) for p, path in parts)

    def span(self) -> tuple[int, int]:
        """The first number that is held and the one after the last; equal if there is none."""
        files = self._files()
        return (files[0][0], files[-1][1]) if files else (0, 0)

    def append(self, first: int, frames: list[bytes]) -> None:
        """Write frames whole or not at all: under another name, which is changed when all is written."""
        name = f"{self.path}/{first:020d}-{first + len(frames):020d}"
        with self.where.open_output_stream(f"{name}.part") as out:
            for f in frames:
                out.write(struct.pack("<I", len(f)) + f)
        self.where.move(f"{name}.part", f"{name}.frames")

    def read(self, start: int, end: int) -> Iterator[tuple[int, bytes]]:
        for first, after, path in self._files():
            if first < end and after > start:
                with self.where.open_input_stream(path) as stream:
                    for n in range(first, after):
                        frame = stream.read(struct.unpack("<I", stream.read(4))[0])
                        if start <= n < end:
                            yield n, frame

    def trim(self, end: int) -> None:
        for _, after, path in self._files():
            if after <= end:
                self.where.delete_file(path)


class Admission:
    """Frames that wait, and when a batch of them is due."""

    def __init__(self, rows: int = FLUSH_ROWS, seconds: float = FLUSH_SECONDS, queue: int = QUEUE_ROWS, clock: Callable[[], float] = time.monotonic):
        self.rows, self.seconds, self.queue, self.clock = rows, seconds, queue, clock
        self.waiting: deque[tuple[float, bytes]] = deque()

    @property
    def full(self) -> bool:
        return len(self.waiting) >= self.queue

    def offer(self, frames: list[bytes]) -> None:
        now = self.clock()
        self.waiting.extend((now, bytes(f)) for f in frames)

    def due(self) -> bool:
        return len(self.waiting) >= self.rows or bool(self.waiting) and self.clock() - self.waiting[0][0] >= self.seconds

    def take(self) -> list[bytes]:
        return [self.waiting.popleft()[1] for _ in range(min(self.rows, len(self.waiting)))]


class FrameReader(SimpleDataSourceStreamReader):
    """Asks the connection until a batch is due; after failures it waits ever longer, up to a minute."""

    def __init__(self, connect: Connect, log: FrameLog, admission: Admission, sleep: Callable[[float], None] = time.sleep):
        self.connect, self.log, self.admission, self.sleep = connect, log, admission, sleep
        self.receive, self.wait, self.reconnects = None, 1.0, 0

    def initialOffset(self) -> dict:
        return {"n": self.log.span()[0]}

    def _ask(self) -> None:
        try:
            self.receive = self.receive or self.connect()
            self.admission.offer(self.receive())
            self.wait = 1.0
        except OSError:
            self.reconnects += 1
            self.sleep(self.wait)
            self.receive, self.wait = None, min(LONGEST_WAIT, 2 * self.wait)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """A batch that is due, or none: what the log holds beyond ``start`` comes before anything new."""
        n, (_, logged) = start["n"], self.log.span()
        if logged > n:
            end = min(logged, n + self.admission.rows)
            return iter(list(self.log.read(n, end))), {"n": end}
        if not self.admission.full:
            self._ask()
        frames = self.admission.take() if self.admission.due() else []
        if frames:
            self.log.append(n, frames)
        return iter(list(enumerate(frames, n))), {"n": n + len(frames)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self.log.read(start["n"], end["n"])

    def commit(self, end: dict) -> None:
        self.log.trim(end["n"])


def frame_source(name: str, connect: Connect, log_path: str, rows: int = FLUSH_ROWS, seconds: float = FLUSH_SECONDS) -> type[DataSource]:
    """A streaming source of a subscription: ``spark.dataSource.register(frame_source(...))``; one query reads a log."""

    class Frames(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "seq bigint, frame binary"

        def simpleStreamReader(self, schema: StructType) -> FrameReader:
            return FrameReader(connect, FrameLog(log_path), Admission(rows, seconds))

    return Frames
