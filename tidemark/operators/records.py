"""Small record operators: lookups, search results, prompts, presets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T

# Domains, suffixes, VRAM in GB, presets.
GAMING_DOMAINS = ("fandom.com", "fextralife.com", "ign.com", "gamespot.com", "polygon.com", "kotaku.com", "pcgamer.com", "eurogamer.net", "gamefaqs.gamespot.com", "reddit.com/r/", "steampowered.com", "playstation.com", "xbox.com", "nintendo.com")
SUFFIXES = {"wiki": " wiki", "guide": " guide walkthrough", "lore": " lore story explained"}
VRAM = {"llm": 16.0, "sam3": 4.0, "siglip": 2.0, "videomae": 1.0, "audio_whisper": 1.0, "hico": 2.0}
PRESETS = (("light", 0.5, 2, 20.0, 0.0), ("standard", 1.0, 5, 28.0, 0.5), ("full", 2.0, 10, 45.0, 1.0))
EVAL_CONFIGS = (("baseline", 64, 4.0, 18.0), ("light", 128, 4.0, 22.0), ("full", 256, 8.0, 35.0))


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRESETS), "preset string, fps double, context_minutes int, vram_gb double, sam_fps double")


def eval_configs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EVAL_CONFIGS), "config string, max_frames int, fps double, vram_gb double")


def preset_frames(media: DataFrame) -> DataFrame:
    """(media_id, name, vram_gb, frames, context_frames): what each preset and evaluation configuration takes of media (media_id, seconds): frames at its rate up to its limit, and those that its context keeps."""
    kinds = "array<struct<name:string,fps:double,kept:double,most:bigint,vram_gb:double>>"
    rows = [F.struct(F.lit(n), F.lit(fps), F.lit(minutes * 60.0), F.lit(None).cast("bigint"), F.lit(gb)) for n, fps, minutes, gb, _ in PRESETS]
    rows += [F.struct(F.lit(f"eval {n}"), F.lit(fps), F.lit(None).cast("double"), F.lit(most).cast("bigint"), F.lit(gb)) for n, most, fps, gb in EVAL_CONFIGS]
    each = media.select("media_id", "seconds", F.explode(F.array(*rows).cast(kinds)).alias("p")).select("media_id", "seconds", "p.*")
    return each.select("media_id", "name", "vram_gb", F.least(F.floor(F.col("seconds") * F.col("fps")), "most").alias("frames"), F.floor(F.least("seconds", "kept") * F.col("fps")).alias("context_frames"))


def vram_breakdown(uses: Column) -> Column:
    """Of a map component -> used, a map component -> GB; the language model is always there."""
    table = F.create_map(*[F.lit(x) for kv in VRAM.items() for x in kv])
    return F.map_filter(table, lambda k, v: (k == "llm") | F.coalesce(F.try_element_at(uses, k), F.lit(False)))


def ranked_results(results: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, seq, title, url, snippet, relevance, source): 1.5 for gaming sites, else 1; the first ``most`` of each query, ties as found."""
    rank = F.when(T.any_of(F.col("url"), GAMING_DOMAINS), 1.5).otherwise(1.0)
    k = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("relevance"), "seq"))
    return results.withColumn("relevance", rank).withColumn("source", T.source_of(F.col("url"))).withColumn("k", k).where(F.col("k") <= most).drop("k")


def result_texts(results: DataFrame, budget: int = 2000) -> DataFrame:
    """Results of each query whose running length fits the budget."""
    w = W.partitionBy("query_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return results.withColumn("chars", F.sum(F.length("title") + F.length("snippet")).over(w)).where(F.col("chars") <= budget)


def expanded_query(query: Column, game: Column, kind: Column) -> Column:
    """The game's name first unless the query has it, then the suffix of the kind of search."""
    named = F.when(game.isNotNull() & ~F.lower(query).contains(F.lower(game)), F.concat_ws(" ", game, query)).otherwise(query)
    suffix = F.lit("")
    for k, s in SUFFIXES.items():
        suffix = F.when(kind == k, s).otherwise(suffix)
    return F.concat(named, suffix)


def trigger_query(kind: Column, concept: Column, event: Column) -> Column:
    return (
        F.when(kind == "concept", F.concat(F.lit("A "), F.coalesce(concept, F.lit("object")), F.lit(" was just detected. Describe what's happening with it.")))
        .when(kind == "audio", F.concat(F.lit("An audio event '"), F.coalesce(event, F.lit("sound")), F.lit("' was detected. What's happening?"))).otherwise("Something triggered. Describe the current situation.")
    )


def where_equal(df: DataFrame, **values) -> DataFrame:
    """Conjunction of equalities; None asks nothing. Lookups by category, concept, benchmark, config, task."""
    for name, value in values.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def where_named(df: DataFrame, column: str, part: str, exact: bool = False) -> DataFrame:
    """Equality, or a substring in any case."""
    return df.where(F.col(column) == part if exact else F.lower(column).contains(part.lower()))


def confident(detections: DataFrame, least: float = 0.5) -> DataFrame:
    """Texts that are not blank, of enough confidence."""
    return detections.where((F.col("confidence") >= least) & (T.stripped(F.col("text")) != ""))


def best_mask(masks: DataFrame, least_area: float = 100.0, least: float = 0.4) -> DataFrame:
    """Of each frame and prompt the most confident mask of enough area, the first of equals."""
    k = F.row_number().over(W.partitionBy("frame_id", "prompt").orderBy(F.desc("confidence"), "det_no"))
    return masks.where((F.col("area") >= least_area) & (F.col("confidence") > least)).withColumn("k", k).where("k = 1").drop("k")


def audible(rows: DataFrame) -> DataFrame:
    """Dialogue of over two characters, descriptions of over five that don't say no audio."""
    n = F.length(T.stripped(F.col("text")))
    return rows.where(F.when(F.col("kind") == "dialogue", n > 2).otherwise((n > 5) & ~F.lower("text").contains("no audio")))


def inside(tokens: DataFrame, start: float, end: float) -> DataFrame:
    """Tokens that lie in the range as a whole."""
    return tokens.where((F.col("start") >= start) & (F.col("end") <= end))


def audio_timeline(speech: DataFrame, events: DataFrame) -> DataFrame:
    """Both as (timeline_id, start, end, kind, text), in order of start."""
    a = speech.select("timeline_id", "start", "end", F.lit("speech").alias("kind"), "text")
    return a.unionByName(events.select("timeline_id", "start", "end", F.col("type").alias("kind"), F.col("description").alias("text"))).orderBy("timeline_id", "start")


def flattened(frames: DataFrame) -> DataFrame:
    """A row for each detection of frames (frame_idx, t_sec, detections)."""
    return frames.select("frame_idx", "t_sec", F.posexplode("detections").alias("det_no", "d")).select("frame_idx", "t_sec", "det_no", "d.text", F.coalesce("d.category", F.lit("unknown")).alias("category"))


def knowledge_lines(tracks: DataFrame) -> DataFrame:
    """One line for each track in order of its first sight."""
    line = F.concat("entity_id", F.lit(": "), T.mmss(F.col("first_seen")), F.lit("-"), T.mmss(F.col("last_seen")), F.lit(", "), F.col("n_frames").cast("string"), F.lit(" frames"))
    return tracks.select("timeline_id", "first_seen", "entity_id", line.alias("line")).orderBy("timeline_id", "first_seen", "entity_id")


def shortened(rows: DataFrame, key: str, order: str, line: str, most: int = 50) -> DataFrame:
    """(key, text): the first lines of each key, and how many more there are. Rows are ranked and counted before any are gathered, so that a group holds ``most`` lines whatever the key has."""
    k = F.row_number().over(W.partitionBy(key).orderBy(order, line))
    first = rows.withColumn("__k", k).where(F.col("__k") <= most).groupBy(F.col(key).alias("__key")).agg(F.sort_array(F.collect_list(F.struct("__k", line))).alias("__l"))
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).join(first, F.col(key).eqNullSafe(F.col("__key")))
    more = F.when(F.col("__n") > most, F.array(F.concat(F.lit("... and "), (F.col("__n") - most).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return counts.select(key, F.array_join(F.concat(F.transform("__l", lambda x: x[line]), more), "\n").alias("text"))


def run_statistics(runs: DataFrame) -> DataFrame:
    """Totals and safe means of a pipeline's runs."""
    return runs.agg(F.count(F.lit(1)).alias("total_samples"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("total_seconds"), (F.coalesce(F.sum("seconds"), F.lit(0.0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("avg_seconds"))


def pipeline_statistics(runs: DataFrame, videos: DataFrame) -> DataFrame:
    """Totals and safe means of a pipeline that perceives a video once (videos: seconds) and answers every sample (runs: seconds)."""
    total = lambda df: F.coalesce(F.sum("seconds"), F.lit(0.0))
    a = runs.agg(F.count(F.lit(1)).alias("total_samples"), total(runs).alias("total_inference_time_sec")).first()
    return videos.agg(
        F.lit(a["total_samples"]).cast("bigint").alias("total_samples"), total(videos).alias("total_perception_time_sec"), F.lit(a["total_inference_time_sec"]).alias("total_inference_time_sec"),
        (total(videos) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("avg_perception_time_sec"), F.lit(a["total_inference_time_sec"] / max(1, a["total_samples"])).alias("avg_inference_time_sec"),
    )


def upserted(entities: DataFrame, seen: DataFrame) -> DataFrame:
    """Entities (entity_id, concept_label, category, first_seen, last_seen) after a batch of sightings: names stay, times widen. For foreachBatch."""
    return entities.unionByName(seen).groupBy("entity_id").agg(F.min_by("concept_label", "first_seen").alias("concept_label"), F.min_by("category", "first_seen").alias("category"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def inferred(rows: DataFrame, model, schema: str) -> DataFrame:
    """The hook for models: ``model(pandas frame) -> pandas frame``, a batch at a time, made once a worker."""

    def run(batches):
        for b in batches:
            yield model(b)

    return rows.mapInPandas(run, schema)
