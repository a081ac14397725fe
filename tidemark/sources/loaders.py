"""Readers of evaluation sets and training pairs, and the writers and caches beside them.

Samples are (sample_id, question, options, answer, task, category, video_path, duration) and what else their record has. Records that lack what a sample needs are dropped, as permissive reading drops what it can't parse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T

SAMPLE = ("sample_id", "question", "options", "answer", "task", "category", "video_path", "duration", "start_time", "end_time", "subcategory", "game_name", "metadata")
VIDEO_GLOB = "*.{mp4,avi,mov,mkv,webm,MP4,AVI,MOV,MKV,WEBM}"
RECORD = "map<string,string>"
# Names of tasks in files, and what they mean.
TASKS = (
    ("visual_unit_test", "visual_qa"), ("visual_regression", "visual_qa"), ("needle_haystack", "needle_in_haystack"), ("needle_in_haystack", "needle_in_haystack"), ("video_needle", "needle_in_haystack"),
    ("glitch_detection", "glitch_detection"), ("video_glitch", "glitch_detection"), ("bug_report", "bug_report"), ("bug_generation", "bug_report"), ("temporal_qa", "temporal_reasoning"), ("action_qa", "action_recognition"),
)


def records(spark: SparkSession, path: str, containers: tuple[str, ...] = ("samples", "data", "questions", "annotations")) -> DataFrame:
    """(file, k, r): records of JSON files that are a list, a list under one of ``containers``, or lists or records by key (then under ``_key``); fields are strings, nested ones JSON."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value"))
    body = F.coalesce(*[F.get_json_object("value", f"$.{c}") for c in containers], F.col("value"))
    raw = raw.withColumn("body", F.trim(body))
    flat = raw.where(F.col("body").startswith("[")).select("file", F.posexplode(F.from_json("body", f"array<{RECORD}>")).alias("k", "r"))
    keyed = raw.where(F.col("body").startswith("{")).select("file", F.explode(F.from_json("body", RECORD)).alias("key", "v"))
    one = keyed.where(F.col("v").startswith("{")).select("file", F.lit(0).alias("k"), F.map_concat(F.from_json("v", RECORD), F.create_map(F.lit("_key"), F.col("key"))).alias("r"))
    many = keyed.where(F.col("v").startswith("[")).select("file", "key", F.posexplode(F.from_json("v", f"array<{RECORD}>")).alias("k", "r")).select("file", "k", F.map_concat("r", F.create_map(F.lit("_key"), F.col("key"))).alias("r"))
    return flat.unionByName(one).unionByName(many).where("r is not null")


def field(*names: str) -> Column:
    return F.coalesce(*[F.try_element_at("r", F.lit(n)) for n in names])


def options() -> Column:
    return F.coalesce(F.from_json(field("options", "choices", "candidates"), "array<string>"), F.array().cast("array<string>"))


def samples(rows: DataFrame, task: Column, answer: Column | None = None, category: Column | None = None) -> DataFrame:
    out = rows.select(
        F.coalesce(field("id", "sample_id", "question_id"), F.concat_ws("_", field("_key"), F.col("k").cast("string"))).alias("sample_id"), field("question", "query").alias("question"), options().alias("options"),
        (field("answer", "ground_truth", "correct_choice") if answer is None else answer).alias("answer"), task.alias("task"), (field("category", "genre", "domain") if category is None else category).alias("category"),
        F.coalesce(field("video_path", "video", "image_path"), field("_key")).alias("video_path"), field("duration", "video_duration").try_cast("double").alias("duration"),
        field("start_time").try_cast("double").alias("start_time"), field("end_time").try_cast("double").alias("end_time"), field("subcategory").alias("subcategory"), field("game", "game_name").alias("game_name"), F.to_json("r").alias("metadata"),
    )
    return out.withColumn("answer_format", T.answer_format(F.col("task"), F.col("options"), F.coalesce("answer", F.lit(""))))


def glitches(spark: SparkSession, path: str) -> DataFrame:
    """Glitch detection: the answer is yes for every sample."""
    return samples(records(spark, path), F.lit("glitch_detection"), F.lit("yes"), field("glitch_type", "glitch-type"))


def glitch_images(spark: SparkSession, path: str) -> DataFrame:
    """The same from Parquet with image bytes."""
    return spark.read.parquet(path).select(F.col("id").cast("string").alias("sample_id"), F.lit("Is there a glitch in this image?").alias("question"), F.lit("yes").alias("answer"), F.col("game"), F.col("`glitch-type`").alias("category"), "image")


def physics(spark: SparkSession, path: str) -> DataFrame:
    return samples(records(spark, path), F.lit("physics_understanding"))


# Domains of physics and their categories.
PHYSICS = {
    "mechanics": ("gravity", "collision", "friction", "inertia", "momentum"), "kinematics": ("velocity", "acceleration", "trajectory", "rotation"),
    "optics": ("lighting", "shadows", "reflections", "transparency"), "materials": ("deformation", "destruction", "fluids", "particles"),
}


def physics_videos(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, video_path, domain, category) of the videos below a folder a domain, listed without reading them: the category is the domain's first that the file's name contains, else unknown. Where no domain has a video, all videos below the folder, of unknown domain."""
    listed = videos(spark, path)
    root = F.regexp_replace(F.lit(path.rstrip("/")), r"^[a-z]+:/*", "/")
    below = F.expr("substring(p, length(r) + 2)")
    rows = listed.withColumn("p", F.regexp_replace("path", r"^[a-z]+:/*", "/")).withColumn("r", root).withColumn("video_path", below).withColumn("domain", F.split("video_path", "/")[0])
    stem = F.lower("video_id")
    category = F.lit("unknown")
    for domain, names in PHYSICS.items():
        for c in reversed(names):
            category = F.when((F.col("domain") == domain) & stem.contains(c), c).otherwise(category)
    rows = rows.withColumn("known", F.col("domain").isin(*PHYSICS) & F.col("video_path").contains("/"))
    some = rows.groupBy().agg(F.coalesce(F.max("known"), F.lit(False)).alias("some")).first()["some"]
    return rows.where(F.col("known") if some else F.lit(True)).select(F.col("video_id").alias("sample_id"), "video_path", F.when(F.col("known"), F.col("domain")).otherwise("unknown").alias("domain"), F.when(F.col("known"), category).otherwise("unknown").alias("category"))


def game_questions(spark: SparkSession, path: str) -> DataFrame:
    """Files a task, by the first task name that the file's name contains."""
    name = F.when(F.lower("file").contains(TASKS[0][0]), TASKS[0][0])
    for t, _ in TASKS[1:]:
        name = name.when(F.lower("file").contains(t), t)
    raw = F.coalesce(field("task", "task_type"), name, F.lit("visual_unit_test"))
    task = F.when(raw == TASKS[0][0], TASKS[0][1])
    for t, meaning in TASKS[1:]:
        task = task.when(raw == t, meaning)
    rows = records(spark, path).withColumn("r", F.map_concat(F.map_filter("r", lambda k, _: k != "raw_task"), F.create_map(F.lit("raw_task"), raw)))
    return samples(rows, task.otherwise("visual_qa")).withColumn("raw_task", F.get_json_object("metadata", "$.raw_task"))


def long_videos(spark: SparkSession, path: str) -> DataFrame:
    """Long-video questions: in one file, by video, or a file a task whose name ends in _test or _val."""
    named = F.regexp_replace(F.regexp_replace("file", r"\.json$", ""), "_(test|val)$", "")
    return samples(records(spark, path), T.long_video_task(F.coalesce(field("task", "question_type", "question_category"), field("_key"), named)))


def long_questions(spark: SparkSession, path: str) -> DataFrame:
    """Long-video questions whose task is told by its name or by the question."""
    return samples(records(spark, path), T.long_question_task(field("task", "type"), F.coalesce(field("question", "query"), F.lit(""))))


def plain_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """{name, version, samples: [...]} with defaults."""
    return samples(records(spark, path), F.coalesce(field("task"), F.lit("visual_qa")))


def checked(value: Column, ok: Column, what: str) -> Column:
    """The value; a record where it is not as it must be ends the job."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.to_json("r"))))


def training_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(question, answer) of records, all of which must have both."""
    q, a = field("question"), field("answer")
    ok = q.isNotNull() & a.isNotNull()
    return records(spark, path).select(checked(q, ok, "no question and answer").alias("question"), a.alias("answer"))


def training_messages(spark: SparkSession, path: str) -> DataFrame:
    """(messages) of records, all of which must have two or more, a user's first and an assistant's second."""
    m = F.from_json(field("messages"), "array<struct<role:string,content:string>>")
    ok = (F.size(m) >= 2) & (F.get(m, 0)["role"] == "user") & (F.get(m, 1)["role"] == "assistant")
    return records(spark, path).select(checked(m, ok, "not a conversation").alias("messages"))


def videos(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, path, length) of video files below a folder, listed without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", VIDEO_GLOB).load(path)
    return files.select(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("video_id"), "path", "length")


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(video, modality, t0, t1, vec)."""
    return spark.read.schema("video string, modality string, t0 double, t1 double, vec array<float>").parquet(path)


def is_video_url(url: Column) -> Column:
    return url.rlike(r"^https?://(www\.)?youtube\.com/watch\?v=|^https?://youtu\.be/|^https?://(www\.)?youtube\.com/shorts/")


def file_key(content: Column, length: Column, ends: int = 1 << 20) -> Column:
    """Sixteen digits of a sha256 over a file's size and its first and last megabyte."""
    return F.substring(F.sha2(F.concat(length.cast("string").cast("binary"), F.substring(content, 1, ends), F.right(content, F.lit(ends))), 256), 1, 16)


def path_key(path: Column, size: Column, mtime: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", path, size.cast("string"), mtime.cast("string")).cast("binary")), 1, 16)


def evicted(cache: DataFrame, budget: int, low_water: float = 0.8) -> DataFrame:
    """Of a cache's files (key, size, mtime in seconds) over its budget the oldest, until what is left fits the low-water mark.

    Sizes are summed by the hour first, and running sums taken over the hours, then within each: no window holds all files.
    """
    hour = F.floor(F.col("mtime") / 3600)
    hours = cache.groupBy(hour.alias("__hour")).agg(F.sum("size").alias("__sum"))
    newer = hours.withColumn("__newer", F.coalesce(F.sum("__sum").over(W.orderBy(F.desc("__hour")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("__total", F.sum("__sum").over(W.partitionBy()))
    own = F.sum("size").over(W.partitionBy("__hour").orderBy(F.desc("mtime"), "key").rowsBetween(W.unboundedPreceding, 0))
    placed = cache.withColumn("__hour", hour).withColumn("__own", own).join(F.broadcast(newer), "__hour")
    return placed.where((F.col("__total") > budget) & (F.col("__newer") + F.col("__own") > budget * low_water)).select(*cache.columns)


def cached_searches(queries: DataFrame, cache: DataFrame, now: float, ttl: float = 86_400.0) -> DataFrame:
    """Queries whose results are cached and fresh: joined by the md5 of the lower-cased query."""
    return queries.withColumn("key", F.md5(F.lower("query").cast("binary"))).join(cache.where(F.col("ts") > now - ttl), "key")


def cache_statistics(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_json has written."""
    return spark.read.text(path).select(F.from_json("value", schema).alias("r")).select("r.*")


def save_conversations(turns: DataFrame, path: str) -> None:
    """Turns (conv_id, turn, role, text) a folder a conversation's hash, so that one is read without the others."""
    turns.withColumn("part", F.pmod(F.xxhash64("conv_id"), F.lit(64))).write.mode("overwrite").partitionBy("part").parquet(path)


def load_conversation(spark: SparkSession, path: str, conv_id: int | None = None) -> DataFrame:
    saved = spark.read.parquet(path)
    if conv_id is not None:
        saved = saved.where((F.col("part") == F.pmod(F.xxhash64(F.lit(conv_id).cast("bigint")), F.lit(64))) & (F.col("conv_id") == conv_id))
    return saved.drop("part")


def write_lines(df: DataFrame, path: str, order: list[str], line: str = "line") -> None:
    """One text file in order; for reports, which are small."""
    df.orderBy(*order).select(line).coalesce(1).write.text(path)


def write_features(df: DataFrame, path: str, key: str = "video_hash") -> None:
    """Features a folder a video; a video written again replaces its own folder alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
