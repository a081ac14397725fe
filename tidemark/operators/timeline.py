"""The event timeline: filters, runs, duplicates, segments, transcripts.

A timeline has (timeline_id, seq, t_sec, modality, description, priority, duration, entity_id, confidence); ``seq`` is the order of arrival and settles every tie. All operators work a timeline at a time, so that they shuffle by timeline_id alone and once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import ordered

# Priorities.
CRITICAL, HIGH, MEDIUM, LOW, DEBUG = range(5)
COLUMNS = ("timeline_id", "seq", "t_sec", "modality", "description", "priority", "duration", "entity_id", "confidence")
ORDER = ("t_sec", "seq")


def events_timeline(events: DataFrame, origin: str = "2024-01-01 00:00:00") -> DataFrame:
    """The ``events`` table as timelines, one a user; seconds since ``origin``."""
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.to_timestamp(F.lit(origin)))) / 1e6
    rank = F.when(F.col("event_type") == "error", CRITICAL).when(F.col("event_type") == "purchase", HIGH).when(F.col("event_type") == "click", MEDIUM).when(F.col("event_type") == "view", LOW).otherwise(DEBUG)
    return events.select(
        F.col("user_id").cast("string").alias("timeline_id"), F.col("event_id").alias("seq"), t.alias("t_sec"), F.col("event_type").alias("modality"),
        F.concat("event_type", F.lit(" "), F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))).alias("description"), rank.alias("priority"),
        F.col("value").alias("duration"), F.col("user_id").cast("string").alias("entity_id"), F.least(F.col("value") / 560, F.lit(1.0)).alias("confidence"),
    )


def end_time(df: DataFrame) -> DataFrame:
    return df.withColumn("end_time", F.col("t_sec") + F.col("duration"))


def in_range(df: DataFrame, start: float | None = None, end: float | None = None, modalities: list[str] | None = None, include_low: bool = False) -> DataFrame:
    """Both ends included; events of LOW priority, and only those, are hidden unless asked for."""
    if start is not None:
        df = df.where(F.col("t_sec") >= start)
    if end is not None:
        df = df.where(F.col("t_sec") <= end)
    if modalities:
        df = df.where(F.col("modality").isin(modalities))
    return df if include_low else df.where(F.col("priority") != LOW)


def around(df: DataFrame, t: float, window: float = 30.0, **more) -> DataFrame:
    """``window`` is the whole span; 0 means the default."""
    half = (window or 30.0) / 2
    return in_range(df, t - half, t + half, **more)


def of_entity(df: DataFrame, entity_id: str, start: float | None = None, end: float | None = None) -> DataFrame:
    return in_range(df.where(F.col("entity_id") == entity_id), start, end, include_low=True)


def of_modality(df: DataFrame, modality: str) -> DataFrame:
    return df.where(F.col("modality") == modality)


def with_run(df: DataFrame, window: float, rows: int = ordered.ROWS) -> DataFrame:
    """``run``: neighbours in time of one modality and entity (null equals null) that are at most ``window`` apart share it.

    A timeline of more than ``rows`` events is cut into pieces of its time, and runs that cross a border are joined by a pass over one row a piece.
    """

    def joins_last(row, last):
        return (last("modality") == row("modality")) & last("entity_id").eqNullSafe(row("entity_id")) & (row("t_sec") - last("t_sec") <= window)

    return ordered.with_islands(df, ["timeline_id"], list(ORDER), joins_last, "run", ["modality", "entity_id", "t_sec"], rows)


def merge_nearby(df: DataFrame, window: float = 0.5, rows: int = ordered.ROWS) -> DataFrame:
    """Runs become one event: earliest time, latest end, most urgent priority, greatest confidence, the first three distinct descriptions; an event alone stays as it is.

    A run is never gathered: its wordings are counted down to the first of each, and of those three are kept before they are moved.
    """
    key = ["timeline_id", "run"]
    first = F.struct(*ORDER, "modality", "description", "entity_id", "duration")
    wordings = with_run(df, window, rows).groupBy(*key, "description").agg(
        F.min(first).alias("first"), F.max(F.col("t_sec") + F.col("duration")).alias("last"), F.min("priority").alias("priority"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"),
    )
    runs = wordings.groupBy(*key).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("priority").alias("priority"), F.max("confidence").alias("confidence"), F.sum("n").alias("n"))
    early = wordings.where("description is not null").withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy("first"))).where("__n <= 3")
    names = early.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("first")), lambda x: x["description"]), "; ").alias("names"))
    one = F.col("n") == 1
    at = F.col("first")
    return runs.join(names.select(F.col("timeline_id").alias("__of"), F.col("run").alias("__run"), "names"), F.col("timeline_id").eqNullSafe(F.col("__of")) & (F.col("run") == F.col("__run")), "left").select(
        "timeline_id", at["seq"].alias("seq"), at["t_sec"].alias("t_sec"), at["modality"].alias("modality"), F.when(one, at["description"]).otherwise(F.coalesce("names", F.lit(""))).alias("description"), "priority",
        F.when(one, at["duration"]).otherwise(F.col("last") - at["t_sec"]).alias("duration"), at["entity_id"].alias("entity_id"), "confidence", F.col("n").alias("n_merged"),
    )


def duplicate_key(df: DataFrame) -> Column:
    return F.concat("modality", F.lit(":"), F.substring(F.lower("description"), 1, 50))


def dedup_first(df: DataFrame) -> DataFrame:
    """The first event of each modality and description prefix in a timeline, however far apart."""
    w = W.partitionBy("timeline_id", duplicate_key(df)).orderBy(*ORDER)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def merge_and_dedupe(df: DataFrame, window: float = 0.5, rows: int = ordered.ROWS) -> DataFrame:
    return dedup_first(merge_nearby(df, window, rows))


def removed_by_merge(df: DataFrame, window: float = 0.5) -> DataFrame:
    """(timeline_id, n_before, n_after, n_removed)."""
    after = merge_and_dedupe(df, window).groupBy("timeline_id").agg(F.count(F.lit(1)).alias("n_after"))
    before = df.groupBy("timeline_id").agg(F.count(F.lit(1)).alias("n_before"))
    return before.join(after, "timeline_id").select("timeline_id", "n_before", "n_after", (F.col("n_before") - F.col("n_after")).alias("n_removed"))


def segments(df: DataFrame, length: float = 10.0) -> DataFrame:
    """Windows [start, start + length) from a timeline's first event while start lies before its last end, empty ones too: (timeline_id, k, start_time, end_time, event_count, summary)."""
    line = F.struct("t_sec", "seq", T.compact(F.col("t_sec"), F.col("modality"), F.col("description")).alias("line"))
    bounds = df.groupBy("timeline_id").agg(F.min("t_sec").alias("lo"), F.max(F.col("t_sec") + F.col("duration")).alias("hi"))
    slots = bounds.where("hi > lo").select("timeline_id", "lo", F.explode(F.sequence(F.lit(0), (F.ceil((F.col("hi") - F.col("lo")) / length) - 1).cast("int"))).alias("k"))
    placed = df.join(bounds.select("timeline_id", "lo"), "timeline_id").withColumn("k", F.floor((F.col("t_sec") - F.col("lo")) / length).cast("int"))
    full = placed.groupBy("timeline_id", "k").agg(F.count(F.lit(1)).alias("event_count"), F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n").alias("summary"))
    start = F.col("lo") + F.col("k") * length
    return slots.join(full, ["timeline_id", "k"], "left").select("timeline_id", "k", start.alias("start_time"), (start + length).alias("end_time"), F.coalesce("event_count", F.lit(0)).alias("event_count"), F.coalesce("summary", F.lit("No events")).alias("summary"))


def statistics(df: DataFrame) -> DataFrame:
    """(timeline_id, total_events, n_entities, first_t, last_t, duration)."""
    return df.groupBy("timeline_id").agg(
        F.count(F.lit(1)).alias("total_events"), F.count_distinct(F.when(F.col("entity_id") != "", F.col("entity_id"))).alias("n_entities"),
        F.min("t_sec").alias("first_t"), F.max(F.col("t_sec") + F.col("duration")).alias("last_t"), (F.max(F.col("t_sec") + F.col("duration")) - F.min("t_sec")).alias("duration"),
    )


def modality_counts(df: DataFrame, modalities: list[str]) -> DataFrame:
    """Events of each listed modality, none counting 0."""
    counts = df.groupBy("modality").agg(F.count(F.lit(1)).alias("n"))
    dim = df.sparkSession.createDataFrame([(m,) for m in modalities], "modality string")
    return dim.join(counts, "modality", "left").select("modality", F.coalesce("n", F.lit(0)).alias("n"))


def truncated(df: DataFrame, most: int = 50) -> DataFrame:
    """Of each timeline the most urgent events; ties by time, then arrival. 0 means the default."""
    w = W.partitionBy("timeline_id").orderBy("priority", *ORDER)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= (most or 50)).drop("__n")


def transcript(df: DataFrame, most: int = 50, **filters) -> DataFrame:
    """(timeline_id, n_lines, transcript): the most urgent events in order of time, a line each."""
    line = T.compact(F.col("t_sec"), F.col("modality"), F.col("description")).alias("line")
    kept = truncated(in_range(df, **filters), most)
    return kept.groupBy("timeline_id").agg(F.count(F.lit(1)).alias("n_lines"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t_sec", "seq", line))), lambda x: x["line"]), "\n").alias("transcript"))


def in_turn(*streams: DataFrame) -> DataFrame:
    """Streams of events one behind the other: ``seq`` is made of the stream's place, then the row's own ``seq`` (below 2**40)."""
    out = None
    for k, df in enumerate(streams):
        own = df.withColumn("seq", F.col("seq") + F.lit(k << 40)).select(*COLUMNS)
        out = own if out is None else out.unionByName(own)
    return out


def event_rows(df: DataFrame, modality: str | Column, description: Column, priority: Column, duration: Column | None = None, entity: Column | None = None) -> DataFrame:
    """Rows (timeline_id, seq, t_sec, confidence, ...) as events of a timeline."""
    kind = F.lit(modality) if isinstance(modality, str) else modality
    return df.select(
        "timeline_id", "seq", "t_sec", kind.alias("modality"), description.alias("description"), priority.cast("int").alias("priority"), (F.lit(0.0) if duration is None else duration).alias("duration"),
        (F.lit(None).cast("string") if entity is None else entity).alias("entity_id"), "confidence",
    )


def fused(ocr: DataFrame, speech: DataFrame, visual: DataFrame) -> DataFrame:
    """A live recording's streams, each (timeline_id, seq, t_sec, text, confidence), speech with end_time, visual with entity_id: text MEDIUM, speech HIGH, visual LOW. At one time text comes first, then speech, then what is seen."""
    text = F.col("text")
    return in_turn(
        event_rows(ocr, "ocr", text, F.lit(MEDIUM)),
        event_rows(speech, "speech", text, F.lit(HIGH), F.col("end_time") - F.col("t_sec")),
        event_rows(visual, "visual", text, F.lit(LOW), entity=F.col("entity_id")),
    )


def fused_extracted(ocr: DataFrame, visual: DataFrame, audio: DataFrame, compressed: DataFrame) -> DataFrame:
    """A recording's extracted streams in their order: text, HIGH over 0.8 confidence; what is seen, HIGH on high action, else MEDIUM; audio (with ``kind``, dialogue being speech), HIGH; and for each timeline with temporal tokens (timeline_id, n_frames, n_tokens) a LOW note at 0."""
    note = F.format_string("Temporal context: %d frames compressed to %d tokens", "n_frames", "n_tokens")
    notes = compressed.where("n_tokens > 0").withColumns({"seq": F.lit(0).cast("bigint"), "t_sec": F.lit(0.0), "confidence": F.lit(1.0)})
    known = F.coalesce("confidence", F.lit(1.0))
    return in_turn(
        event_rows(ocr.withColumn("rank", F.when(F.col("confidence") > 0.8, HIGH).otherwise(MEDIUM)).withColumn("confidence", known), "ocr", F.concat(F.lit('Text: "'), "text", F.lit('"')), F.col("rank")),
        event_rows(visual.withColumn("confidence", known), "visual", F.col("text"), F.when(F.col("motion_type") == "high_action", HIGH).otherwise(MEDIUM)),
        event_rows(audio.withColumn("confidence", F.lit(1.0)), F.when(F.col("kind") == "dialogue", "speech").otherwise("audio"), F.col("text"), F.lit(HIGH), F.coalesce("end_time", "t_sec") - F.col("t_sec")),
        event_rows(notes, "temporal", note, F.lit(LOW)),
    )


def from_entities(tracked: DataFrame, frame_idx: int, t_sec: float) -> DataFrame:
    """The entities (timeline_id, seq, entity_id, concept_label, frame_idx, confidence) with a mask in one frame, as events at its time."""
    rows = tracked.where(F.col("frame_idx") == frame_idx).withColumn("t_sec", F.lit(float(t_sec)))
    return event_rows(rows, "visual", F.concat("concept_label", F.lit(" detected")), F.lit(MEDIUM), entity=F.col("entity_id"))


def from_audio(segments: DataFrame, sounds: DataFrame) -> DataFrame:
    """Speech segments, then sounds, each (timeline_id, seq, t_sec, end_time, text, confidence), as events."""
    length = F.col("end_time") - F.col("t_sec")
    return in_turn(event_rows(segments, "speech", F.col("text"), F.lit(MEDIUM), length), event_rows(sounds, "audio", F.col("text"), F.lit(MEDIUM), length))


def appended(timeline: DataFrame, events: DataFrame) -> DataFrame:
    """The timeline with events behind it: they arrive after all that their timeline has."""
    last = timeline.groupBy("timeline_id").agg(F.max("seq").alias("__last"))
    own = events.withColumn("__k", F.row_number().over(W.partitionBy("timeline_id").orderBy("seq"))).join(last, "timeline_id", "left")
    return timeline.select(*COLUMNS).unionByName(own.withColumn("seq", F.coalesce(F.col("__last") + F.col("__k"), F.col("__k") - 1)).select(*COLUMNS))


def from_tokens(tokens: DataFrame) -> DataFrame:
    """Temporal tokens (timeline_id, seq, start, end, level, source_frame_count) as events."""
    return tokens.select("timeline_id", "seq", F.col("start").alias("t_sec"), F.lit("temporal").alias("modality"), F.concat(F.col("level"), F.lit(" segment ("), F.col("source_frame_count").cast("string"), F.lit(" frames)")).alias("description"), F.lit(MEDIUM).alias("priority"), (F.col("end") - F.col("start")).alias("duration"), F.lit(None).cast("string").alias("entity_id"), F.lit(1.0).alias("confidence"))


def from_text(detections: DataFrame) -> DataFrame:
    """On-screen text (timeline_id, seq, t_sec, text, confidence) as events: damage and health MEDIUM, else LOW."""
    kind = T.ocr_category(F.col("text"))
    return detections.select("timeline_id", "seq", "t_sec", F.lit("ocr").alias("modality"), F.col("text").alias("description"), F.when(kind.isin("damage", "health"), MEDIUM).otherwise(LOW).alias("priority"), F.lit(0.0).alias("duration"), F.lit(None).cast("string").alias("entity_id"), "confidence")


def clean_text(detections: DataFrame, least: float = 0.7) -> DataFrame:
    """Text of enough confidence (0.8 where unknown) and three characters, the first of each wording in a timeline."""
    ok = detections.where((F.coalesce("confidence", F.lit(0.8)) >= least) & (F.length(T.stripped(F.col("text"))) >= 3))
    key = F.regexp_replace(F.lower(T.stripped(F.col("text"))), r"\s+", " ")
    w = W.partitionBy("timeline_id", key).orderBy(*ORDER)
    return ok.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def rolling_context(df: DataFrame, seconds: float = 300.0, most: int = 2048) -> DataFrame:
    """For each event how many rows the context holds once it has come: within ``seconds`` before it, at most ``most``."""
    n = F.expr(f"count(1) over (partition by timeline_id order by t_sec range between {float(seconds)}D preceding and current row)")
    return df.withColumn("n_context", F.least(n, F.lit(most)))


def context_sizes(df: DataFrame, seconds: float = 300.0, most: int = 2048, rows: int = ordered.ROWS) -> DataFrame:
    """For each row (timeline_id, t_sec, seq) ``n_context`` and ``span`` of the context once it has come, rows of its own time by ``seq``.

    A hot timeline is cut into stretches of at least ``seconds``; a row counts in its own stretch and, as one that only came before, in the next, so that no stretch needs another's rows.
    """
    piece, own, n, lo, hi, span = (ordered.name(x) for x in ("piece", "own", "n", "lo", "hi", "span"))
    hot = df.groupBy("timeline_id").agg(F.count(F.lit(1)).alias(n), F.min("t_sec").alias(lo), F.max("t_sec").alias(hi)).where(F.col(n) > rows)
    hot = hot.select(F.col("timeline_id").alias("__of"), lo, F.greatest((F.col(hi) - F.col(lo)) / F.ceil(F.col(n) / rows), F.lit(float(seconds or 1.0))).alias(span))
    placed = df.join(hot, F.col("timeline_id").eqNullSafe(F.col("__of")), "left").withColumn(piece, F.coalesce(F.floor((F.col("t_sec") - F.col(lo)) / F.col(span)), F.lit(0)))
    copies = F.when(F.col("__of").isNull(), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))
    both = placed.select(*df.columns, piece, F.explode(copies).alias(own)).withColumn(piece, F.col(piece) + F.when(F.col(own), 0).otherwise(1))
    w = W.partitionBy("timeline_id", piece).orderBy(*ORDER)
    # Rows so far, less those that the window has left behind.
    so_far = F.row_number().over(w)
    left = F.expr(f"count(1) over (partition by timeline_id, {piece} order by t_sec range between unbounded preceding and current row)") - F.expr(f"count(1) over (partition by timeline_id, {piece} order by t_sec range between {float(seconds)}D preceding and current row)")
    first = F.expr(f"min(t_sec) over (partition by timeline_id, {piece} order by t_sec range between {float(seconds)}D preceding and current row)")
    sized = both.withColumn("n_context", F.least(so_far - left, F.lit(most))).withColumn("span", F.col("t_sec") - F.greatest(first, F.lag("t_sec", most - 1).over(w)))
    return sized.where(F.col(own)).select(*df.columns, "n_context", "span")


def final_context(df: DataFrame, seconds: float = 300.0, most: int = 2048) -> DataFrame:
    """The rows that the context holds at a timeline's end."""
    newest = F.max("t_sec").over(W.partitionBy("timeline_id"))
    kept = df.withColumn("__t", newest).where(F.col("t_sec") >= F.col("__t") - seconds).drop("__t")
    w = W.partitionBy("timeline_id").orderBy(F.desc("t_sec"), F.desc("seq"))
    return kept.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def budgeted(df: DataFrame, key: str, order: list[str], text: str, budget: int) -> DataFrame:
    """Rows of each key before the first that overflows a budget of characters, with their running length."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("chars", F.sum(F.length(text)).over(w)).where(F.col("chars") <= budget)
