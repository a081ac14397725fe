"""Training samples of embeddings: what each one should say, from the events around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import joins

# Modalities, what is said where nothing is near, and the templates of targets.
MODALITIES = ("siglip", "videomae", "wav2vec2")
NOTHING = ("Visual content detected", "Temporal video segment", "Audio segment detected")
TARGETS = ("At timestamp %ss, the visual analysis shows: %s", "From %ss to %ss, the temporal analysis shows: %s", "Audio from %ss to %ss: %s")


def training_samples(images: DataFrame, clips: DataFrame, sounds: DataFrame, events: DataFrame, transcripts: DataFrame, near: float = 2.0) -> DataFrame:
    """(video, modality, emb_id, t_sec, context, target).

    ``images`` (timeline_id, emb_id, t_emb) take the first three events within ``near`` seconds; ``clips`` and ``sounds`` (timeline_id, clip_id, start, end) the first five events, and all transcripts, in their range, both ends included. Events and transcripts are (timeline_id, t_sec, seq, description), in order of time; empty ones say nothing. Without a time there is no target.
    """
    said = lambda df: df.where(F.length("description") > 0)
    seen, heard = said(events), said(transcripts)
    a = images.select("timeline_id", "emb_id", F.col("t_emb").alias("start"), F.col("t_emb").alias("end")).join(joins.texts_near(images, seen, near, 3, NOTHING[0]), "emb_id")
    b = clips.select("timeline_id", F.col("clip_id").alias("emb_id"), "start", "end").join(joins.texts_within(clips, seen, "; ", 5, NOTHING[1]).withColumnRenamed("clip_id", "emb_id"), "emb_id")
    c = sounds.select("timeline_id", F.col("clip_id").alias("emb_id"), "start", "end").join(joins.texts_within(sounds, heard, " ", None, NOTHING[2]).withColumnRenamed("clip_id", "emb_id"), "emb_id")
    out = None
    for modality, template, rows in zip(MODALITIES, TARGETS, (a, b, c)):
        times = ["start"] if modality == "siglip" else ["start", "end"]
        target = F.when(F.col("start").isNotNull() & F.col("end").isNotNull(), F.format_string(template, *[T.tenths(F.col(t)) for t in times], "joined"))
        own = rows.select(F.col("timeline_id").alias("video"), F.lit(modality).alias("modality"), "emb_id", F.col("start").alias("t_sec"), F.col("joined").alias("context"), target.alias("target"))
        out = own if out is None else out.unionByName(own)
    return out


def place(key: Column, seed: str) -> Column:
    """A row's place in a shuffle that hangs on the seed and its key alone."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def sampled(rows: DataFrame, strata: list[str], key: str, most: int, seed: str = "42", parts: int = 64) -> DataFrame:
    """Of each stratum at most ``most`` rows, the first of a seeded shuffle by ``key``; the same under any partitioning. A large stratum is cut into parts that each keep their first, before these meet."""
    hash_, n = place(F.col(key), seed), "__n"
    for split in (parts, 1):
        w = W.partitionBy(*strata, F.pmod(F.xxhash64(key), F.lit(split))).orderBy(hash_, key)
        rows = rows.withColumn(n, F.row_number().over(w)).where(F.col(n) <= most).drop(n)
    return rows


def shuffled_head(rows: DataFrame, key: str, most: int, seed: str = "42") -> DataFrame:
    """At most ``most`` rows: all if there are no more, else the first of a seeded shuffle by ``key``."""
    return rows.orderBy(place(F.col(key), seed), key).limit(most)


def by_modality(samples: DataFrame) -> dict[str, DataFrame]:
    return {m: samples.where(F.col("modality") == m) for m in MODALITIES}
