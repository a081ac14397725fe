"""Readers by name, to which an application adds its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources import audio, frames, loaders

Reader = Callable[..., DataFrame]


def _wav(spark: SparkSession, path: str, **options) -> DataFrame:
    audio.register(spark)
    return spark.read.format("wav").options(**options).load(path)


def _y4m(spark: SparkSession, path: str, **options) -> DataFrame:
    frames.register(spark)
    return spark.read.format("y4m").options(**options).load(path)


READERS: dict[str, Reader] = {
    "glitches": loaders.glitches, "glitch_images": loaders.glitch_images, "physics": loaders.physics, "game_questions": loaders.game_questions, "long_questions": loaders.long_questions, "long_videos": loaders.long_videos,
    "plain": loaders.plain_benchmark, "training_pairs": loaders.training_pairs, "training_messages": loaders.training_messages, "videos": loaders.videos, "embeddings": loaders.embeddings, "wav": _wav, "y4m": _y4m,
}


def register(name: str, reader: Reader, replace: bool = False) -> None:
    """Adds a reader, a function of (spark, path, ...); a name that is taken only with ``replace``."""
    if name in READERS and not replace:
        raise ValueError(f"there is a reader {name} already")
    READERS[name] = reader


def read(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    if name not in READERS:
        raise ValueError(f"no reader {name}; there are {', '.join(sorted(READERS))}")
    return READERS[name](spark, path, **options)
