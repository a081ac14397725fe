"""Mixing sources to target weights: repetition rates by source, whole copies and one drawn by the document's hash."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, written

WORD = r"[^\x20\x09-\x0D]+"
#: A draw is this many hexadecimal digits of an md5, as a fraction.
DIGITS = 13


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("bigint")


def draw(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) that hangs on the id, or without one on the text."""
    key = F.coalesce(doc_id.cast("string"), text.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, DIGITS), 16, 10).cast("bigint") / F.lit(float(16**DIGITS))


def _running(rows: DataFrame, order: list[Column], sums: dict[str, Column], parts: int) -> DataFrame:
    """Rows with running sums in a global order. Ranges of rows are summed in themselves and then among each other, so that no task holds more than a range."""
    part = "__part"
    placed = written(rows.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()), "mixing-ranges")
    inside, whole = W.partitionBy(part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0), W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    bases = placed.groupBy(part).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    bases = bases.select(part, *[F.coalesce(F.sum(name).over(whole), F.lit(0)).alias(f"__{name}") for name in sums])
    out = placed.withColumns({name: F.sum(c).over(inside) for name, c in sums.items()}).join(F.broadcast(bases), part)  # a row for each range
    return out.withColumns({name: F.col(name) + F.col(f"__{name}") for name in sums}).drop(part, *[f"__{name}" for name in sums])


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, draw) of every row."""
    doc_id, text = F.col(id_col), F.col(text_col)
    return docs.select(doc_id.cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), draw(doc_id, text, seed).alias("draw"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, weight, target, rate) of every source of (source, size).

    Sources by code point, null last, take the weights in turn and share all words. A target stops at ``most`` times its source's size and the excess goes to the others by weight, until none is above: that is min(most * size, weight * level), and the level follows from the sources that stop, which are the first ones by size over weight. Sources without words have target and rate 0.
    """
    spark, parts = sizes.sparkSession, partitions(sizes.sparkSession)
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = _running(each, [F.col("source").isNull().alias("unnamed"), F.col("source")], {"place": F.lit(1).cast("bigint")}, parts)
    turn = F.array(*[F.lit(int(w)) for w in weights])
    weighed = ranked.withColumn("weight", turn[((F.col("place") - 1) % len(weights)).cast("int")])
    stop = (F.col("source_size") * most).cast("double")
    ordered = _running(weighed.withColumn("stops_at", stop / F.col("weight")), [F.col("stops_at"), F.col("place")], {"stopped": F.col("source_size") * most, "held": F.col("weight").cast("bigint")}, parts)
    ordered = written(ordered, "mixing-sources")
    total = ordered.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).first()
    # The level, if just the sources before this one stopped; the first source that it doesn't stop has the true one.
    words, held = F.lit(total["words"] or 0) - F.col("stopped") + F.col("source_size") * most, F.lit(total["weights"] or 0) - F.col("held") + F.col("weight")
    fits = ordered.withColumn("level", words.cast("double") / held).where(F.col("level") <= F.col("stops_at"))
    level = fits.agg(F.min_by("level", F.struct("stops_at", "place")).alias("level")).first()["level"]
    out = ordered.withColumn("target", F.least(stop, F.col("weight") * F.lit(float(level or 0))))
    return out.select("source", "source_size", "weight", "target", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0).alias("rate"))


def copies_of(rate: Column, drawn: Column) -> Column:
    """Copies at a rate: its whole part, and one more with the probability of its fraction."""
    return (F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def repetitions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, rate, copies) of every row of ``docs``: how often the mix takes it.

    A document is taken floor(rate) times, and once more if its draw is below the fraction. The draw is the md5 of the seed and the id, so that reruns and any partitioning agree; rows without an id draw by their text, and repeated rows share a draw and count each. Null and empty texts have size 0 and are taken as often as others of their source. Null sources are one source, the last. Empty tables give no rows. Other columns are ignored.

    Each text is read once, for its size and draw; the sources' table is joined by broadcast as long as its file is below Spark's threshold, else by a sort-merge join whose hot partitions Spark splits.
    """
    sizes = written(sized(docs, id_col, text_col, source_col, seed), "mixing-sizes")
    sources = written(source_targets(sizes, weights, most), "mixing-targets").withColumnRenamed("source", "of")
    joined = sizes.join(sources, F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", copies_of(F.col("rate"), F.col("draw")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "rate", "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix", copy_col: str = "copy") -> DataFrame:
    """The mix itself: every row of ``docs``, all its columns, as often as ``repetitions`` says, numbered from 1 in ``copy_col`` (which replaces a column of that name)."""
    row, of, name = (f"__{x}_{uuid.uuid4().hex[:12]}" for x in ("row", "of", "source"))
    sources = written(source_targets(docs.select(F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")), weights, most), "mixing-targets")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != copy_col]).alias(row), F.col(source_col).cast("string").alias(name), draw(F.col(id_col), F.col(text_col), seed).alias("draw"))
    joined = rows.join(sources.select(F.col("source").alias(of), "rate"), F.col(name).eqNullSafe(F.col(of))).withColumn("copies", copies_of(F.col("rate"), F.col("draw")))
    return joined.where("copies > 0").select(f"{row}.*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(copy_col))


ORACLE = f"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, text, '')), 1, {DIGITS}))::bigint / {16**DIGITS}::double as draw from documents),
s as (select source, sum(size)::bigint as source_size, 1 + (row_number() over (order by source nulls last) - 1) % 3 as weight from d group by source),
o as (select *, 3 * source_size / weight::double as stops_at, coalesce(sum(3 * source_size) over w, 0) as stopped, coalesce(sum(weight) over w, 0) as held,
    sum(source_size) over () as words, sum(weight) over () as weights
    from s window w as (order by 3 * source_size / weight::double, source nulls last rows between unbounded preceding and 1 preceding)),
l as (select arg_min(lvl, (stops_at, lvl)) as lvl from (select *, (words - stopped)::double / (weights - held) as lvl from o) where lvl <= stops_at),
t as (select source, source_size, least(3.0 * source_size, weight * coalesce(lvl, 0))::double as target from o, l),
r as (select *, case when source_size > 0 then least(target / source_size, 3.0) else 0.0 end::double as rate from t)
select doc_id, size, source_size, target, (size * (floor(rate) + case when draw < rate - floor(rate) then 1 else 0 end))::bigint as taken, d.source, rate,
    (floor(rate) + case when draw < rate - floor(rate) then 1 else 0 end)::int as copies
from d join r on d.source is not distinct from r.source
"""


def op12_mixing(spark, sf_dir: str) -> DataFrame:
    return repetitions(spark.read.parquet(f"{sf_dir}/documents.parquet"))
