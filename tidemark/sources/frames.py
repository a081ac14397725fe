"""Uncompressed video as a data source: ``spark.read.format("y4m")`` gives sampled frames.

All frames of a YUV4MPEG2 file have one length, so files are cut by bytes: a task reads the header and seeks to the sampled frames that begin in its range; what lies between them is never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from tidemark.sources.audio import Part, Parts, filesystem, parts

SCHEMA = "path string, frame_idx bigint, t_sec double, width int, height int, pixels binary"
#: The words that begin a file and a frame, and frames a second that are sampled.
MAGIC, FRAME, FPS = b"YUV4MPEG2", b"FRAME\n", 0.5
#: Bytes of a file that one task takes; bytes in which a header must end; bytes of pixels in a batch.
SPLIT, HEADER, BATCH = 32 << 20, 1 << 12, 16 << 20


class Format:
    """What a file's first line says: size, frames a second, and how much smaller the planes of colour are (0 for none)."""

    def __init__(self, line: bytes, name: str):
        words = line.split()
        if not words or words[0] != MAGIC:
            raise ValueError(f"{name} is not a YUV4MPEG2 file")
        tags = {w[:1]: w[1:] for w in words[1:]}
        try:
            self.width, self.height = int(tags[b"W"]), int(tags[b"H"])
            over, under = map(int, tags[b"F"].split(b":"))
            self.fps = over / under
        except (KeyError, ValueError, ZeroDivisionError) as e:
            raise ValueError(f"{name} has no size or rate") from e
        if self.width < 1 or self.height < 1 or self.fps <= 0:
            raise ValueError(f"{name} has no size or rate")
        colour = tags.get(b"C", b"420")
        if colour in (b"420", b"420jpeg", b"420mpeg2", b"420paldv"):
            self.shrink = (2, 2)
        elif colour in (b"422", b"444", b"mono"):
            self.shrink = {b"422": (1, 2), b"444": (1, 1), b"mono": (0, 0)}[colour]
        else:
            raise ValueError(f"{name} has colours of an unknown format")
        self.start, self.luma = len(line) + 1, self.width * self.height
        down, across = self.shrink
        self.small = (-(-self.height // down), -(-self.width // across)) if down else (0, 0)
        self.block = len(FRAME) + self.luma + 2 * self.small[0] * self.small[1]

    def grey(self, body: bytes) -> bytes:
        return body[: self.luma]

    def rgb(self, body: bytes) -> bytes:
        """Three bytes a pixel: BT.601 with video levels, in integers."""
        flat = np.frombuffer(body, np.uint8).astype(np.int32)
        y = 298 * (flat[: self.luma].reshape(self.height, self.width) - 16) + 128
        u = v = np.zeros_like(y)
        if self.shrink[0]:
            n = self.small[0] * self.small[1]
            wide = lambda p: (p.reshape(self.small) - 128).repeat(self.shrink[0], 0).repeat(self.shrink[1], 1)[: self.height, : self.width]
            u, v = wide(flat[self.luma : self.luma + n]), wide(flat[self.luma + n :])
        planes = [(y + 409 * v) >> 8, (y - 100 * u - 208 * v) >> 8, (y + 516 * u) >> 8]
        return np.stack(planes, -1).clip(0, 255).astype(np.uint8).tobytes()


class Y4mReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.glob = options["path"], options.get("pathglobfilter", "*.y4m")
        self.fps, self.split, self.pixels = float(options.get("fps", FPS)), int(options.get("split", SPLIT)), options.get("pixels", "rgb")
        if self.fps <= 0 or self.split < 1 or self.pixels not in ("rgb", "grey"):
            raise ValueError("fps and split are greater than 0, pixels are rgb or grey")

    def partitions(self) -> list[Parts]:
        return parts(self.path, self.glob, self.split)

    def read(self, partition: Parts) -> Iterator[pa.RecordBatch]:
        for part in partition.pieces:
            yield from self.sampled(part)

    def sampled(self, part: Part) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(self.path)
        with store.open_input_file(part.path) as file:
            f = Format(file.read(HEADER).split(b"\n", 1)[0], part.path)
            step = max(1, int(f.fps / self.fps))
            # The first sampled frame that begins in the range.
            k = -(-max(0, part.low - f.start) // f.block)
            k = -(-k // step) * step
            taken = []
            # A frame that the file's end cuts short is none.
            while f.start + k * f.block < part.high and f.start + (k + 1) * f.block <= part.size:
                file.seek(f.start + k * f.block)
                body = file.read(f.block)
                if not body.startswith(FRAME):
                    raise ValueError(f"{part.path}: frame {k} has a head of its own, or none")
                taken.append((k, (f.rgb if self.pixels == "rgb" else f.grey)(body[len(FRAME) :])))
                if len(taken) * f.block >= BATCH:
                    yield self.batch(part.path, f, taken)
                    taken = []
                k += step
            if taken:
                yield self.batch(part.path, f, taken)

    def batch(self, path: str, f: Format, taken: list[tuple[int, bytes]]) -> pa.RecordBatch:
        n = len(taken)
        columns = [[path] * n, [k for k, _ in taken], [k / f.fps for k, _ in taken], [f.width] * n, [f.height] * n, [p for _, p in taken]]
        types = [pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["path", "frame_idx", "t_sec", "width", "height", "pixels"])


class Y4m(DataSource):
    """``spark.read.format("y4m").load(path)``: a file, or the files below a folder. Options: ``fps`` (every int(rate / fps)-th frame, at least every one), ``pixels`` (``rgb`` or ``grey``), ``split`` in bytes, ``pathGlobFilter``. A file that isn't YUV4MPEG2 is an error; one without a whole frame has no row."""

    @classmethod
    def name(cls) -> str:
        return "y4m"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Y4mReader:
        return Y4mReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Y4m)


def file(frames: list[bytes], width: int, height: int, rate: str = "25:1", colour: str = "mono") -> bytes:
    """A file of raw frames."""
    head = MAGIC + f" W{width} H{height} F{rate} Ip A1:1 C{colour}\n".encode()
    return head + b"".join(FRAME + f for f in frames)
