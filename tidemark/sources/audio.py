"""Audio as a data source: ``spark.read.format("wav")`` gives chunks of mono samples at one rate.

Files are cut by bytes. A task reads the header, and of the samples those of its chunks and a few beside them, so that a chunk has the samples that resampling the whole file would give it.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Samples a second that models take, seconds of a chunk, and seconds that it shares with the next.
RATE, CHUNK, OVERLAP = 16_000, 30.0, 0.5
SCHEMA = "path string, chunk bigint, start double, end double, rate int, samples array<float>"
#: Bytes of a file that one task takes; taps on each side of the filter, in samples of the slower rate.
SPLIT, REACH = 32 << 20, 10
#: Bytes that opening a file counts as, when small ones are put together.
OPENING = 256 << 10


def filesystem(path: str):
    """(file system, path) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Header:
    """Format and place of a WAV file's samples: integers of 8, 16, 24 or 32 bits, or floats of 32 or 64."""

    def __init__(self, file, size: int, name: str):
        riff = file.read(12)
        if len(riff) < 12 or riff[:4] != b"RIFF" or riff[8:] != b"WAVE":
            raise ValueError(f"{name} is not a WAV file")
        at, found = 12, None
        while True:
            head = file.read(8)
            if len(head) < 8:
                raise ValueError(f"{name} has no samples")
            kind, length = head[:4], struct.unpack("<I", head[4:])[0]
            at += 8
            if kind == b"fmt ":
                body = file.read(length + length % 2)
                code, self.channels, self.rate, _, self.block, self.bits = struct.unpack("<HHIIHH", body[:16])
                self.code = struct.unpack("<H", body[24:26])[0] if code == 0xFFFE else code
                found = True
                at += length + length % 2
            elif kind == b"data":
                if not found or (self.code, self.bits) not in ((1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)):
                    raise ValueError(f"{name} has samples of an unknown format")
                # Writers that don't know the length leave it at its greatest.
                self.start, self.frames = at, max(0, min(length, size - at)) // self.block
                return
            else:
                at += length + length % 2
                file.seek(at)

    def mono(self, file, first: int, n: int) -> np.ndarray:
        """``n`` samples from ``first``, the mean of the channels, in [-1, 1)."""
        file.seek(self.start + first * self.block)
        raw = file.read(n * self.block)
        if self.code == 3:
            x = np.frombuffer(raw, f"<f{self.bits // 8}").astype(float)
        elif self.bits == 8:
            x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
        elif self.bits == 24:
            b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
            x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 2.0**23
        else:
            x = np.frombuffer(raw, f"<i{self.bits // 8}") / 2.0 ** (self.bits - 1)
        return x.reshape(-1, self.channels).mean(1)


class Resampler:
    """From one rate to another by a polyphase filter: a Kaiser-windowed low pass, whose phases are the rows of a table."""

    def __init__(self, source: int, target: int):
        g = math.gcd(source, target)
        self.up, self.down = target // g, source // g
        most = max(self.up, self.down)
        half = REACH * most
        k = np.arange(-half, half + 1)
        taps = np.sinc(k / most) * np.kaiser(2 * half + 1, 5.0)
        taps *= self.up / taps.sum()
        width = -(-(2 * half + 1) // self.up)
        padded = np.zeros(width * self.up)
        padded[: len(taps)] = taps
        self.half, self.width, self.phases = half, width, padded.reshape(width, self.up).T

    def length(self, n: int) -> int:
        return -(-n * self.up // self.down)

    def needs(self, first: int, n: int) -> tuple[int, int]:
        """Samples [low, high) that the outputs [first, first + n) hang on; they may lie outside the file, where it is silent."""
        low = (first * self.down + self.half) // self.up - self.width + 1
        return low, ((first + n - 1) * self.down + self.half) // self.up + 1

    def run(self, x: np.ndarray, low: int, first: int, n: int) -> np.ndarray:
        """Outputs [first, first + n) of samples whose first has the number ``low``."""
        if self.up == self.down:
            return x[first - low : first - low + n]
        at = np.arange(first, first + n) * self.down + self.half
        base, phase = at // self.up - low, at % self.up
        out = np.empty(n)
        for a in range(0, n, 1 << 14):
            part = slice(a, a + (1 << 14))
            out[part] = (x[base[part, None] - np.arange(self.width)] * self.phases[phase[part]]).sum(1)
        return out


class Part(InputPartition):
    def __init__(self, path: str, size: int, low: int, high: int):
        self.path, self.size, self.low, self.high = path, size, low, high


class Parts(InputPartition):
    """What one task reads."""

    def __init__(self, pieces: list[Part]):
        self.pieces = pieces


def parts(path: str, glob: str, split: int) -> list[Parts]:
    """Ranges of at most ``split`` bytes of the files below a path, small ones together in a task; only the files' sizes are read."""
    from pyarrow import fs

    store, path = filesystem(path)
    info = store.get_file_info(path)
    files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
    files = [f for f in files if f.type == fs.FileType.File and fnmatch(f.base_name.lower(), glob.lower())]
    tasks, cost = [], SPLIT
    for f in sorted(files, key=lambda f: f.path):
        for low in range(0, max(f.size, 1), split):
            high = min(low + split, f.size)
            if cost + high - low + OPENING > SPLIT:
                tasks.append(Parts([]))
                cost = 0
            tasks[-1].pieces.append(Part(f.path, f.size, low, high))
            cost += high - low + OPENING
    return tasks


class WavReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.glob = options["path"], options.get("pathglobfilter", "*.wav")
        self.rate, self.chunk, self.overlap, self.split = int(options.get("rate", RATE)), float(options.get("chunk", CHUNK)), float(options.get("overlap", OVERLAP)), int(options.get("split", SPLIT))
        if not 0 <= self.overlap < self.chunk:
            raise ValueError("chunks overlap by less than their length")

    def partitions(self) -> list[Parts]:
        return parts(self.path, self.glob, self.split)

    def read(self, partition: Parts) -> Iterator[pa.RecordBatch]:
        for part in partition.pieces:
            yield from self.chunks(part)

    def chunks(self, part: Part) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(self.path)
        with store.open_input_file(part.path) as file:
            h = Header(file, part.size, part.path)
            r = Resampler(h.rate, self.rate)
            total = r.length(h.frames)
            length, step = round(self.chunk * self.rate), max(1, round((self.chunk - self.overlap) * self.rate))
            # A chunk is read where its first sample lies; one that only repeats the end of the last isn't there.
            k = 0 if not part.low else max(0, (part.low - h.start) // h.block * r.up // r.down // step - 1)
            while k * step < total and (k == 0 or k * step + length - step < total):
                first = k * step
                byte = h.start + first * r.down // r.up * h.block
                if byte >= part.high:
                    break
                if byte >= part.low or not part.low:
                    n = min(length, total - first)
                    low, high = r.needs(first, n)
                    a, b = max(0, low), min(high, h.frames)
                    x = np.pad(h.mono(file, a, b - a), (a - low, high - b))
                    out = r.run(x, low, first, n).astype(np.float32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part.path]), pa.array([k], pa.int64()), pa.array([first / self.rate]), pa.array([(first + n) / self.rate]), pa.array([self.rate], pa.int32()), pa.array([out], pa.list_(pa.float32()))],
                        ["path", "chunk", "start", "end", "rate", "samples"],
                    )
                k += 1


class Wav(DataSource):
    """``spark.read.format("wav").load(path)``: a file, or the files below a folder. Options: ``rate``, ``chunk`` and ``overlap`` in seconds, ``split`` in bytes, ``pathGlobFilter``. A file that isn't WAV is an error; one without samples has no chunk."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WavReader:
        return WavReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Wav)


def pcm(samples: bytes, rate: int, channels: int = 1, bits: int = 16) -> bytes:
    """A WAV file of raw samples."""
    block = channels * bits // 8
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * block, block, bits) + b"data" + struct.pack("<I", len(samples)) + samples
