"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is that of their hashes; pivots cut it into fragments. Every text's set of n-grams is cut at the same pivots, the overlap of a pair is counted fragment by fragment, and the counts are summed a pair.

Which pairs are counted is found without loss. Sets that are equal become one class, known by its smallest id. Of each set the least hashes are looked at, a quarter first and half for those left: a linked partner lacks at most a fifth of the set, so that many of these must recur in other classes, or the class has no link. The recurring ones of the half are then ranked by how many classes have them, and linked classes must meet before a place in that order that leaves fewer than they must share.

The classes left are ranked once more over their whole sets. Those that meet at an n-gram are first counted against one of them, the hub, and linked; then only pairs are counted that those links leave in different components and whose overlaps with the hub allow a link. So a large group of near copies gives pairs in proportion to its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY_BITS, checkpointed, components, forget, id_filter, id_place, lists, passing, shingle_set, slices, written

SHINGLE = 5
PERCENT = 80
FRAGMENTS = 4
#: Shares of a set that the searches look at, in percent; over 100 - PERCENT, so that several n-grams must recur.
FIRST, SECOND = 25, 50


def least_overlap(n: int) -> int:
    """Of a set of n, what any linked partner shares with it at least."""
    return -(-n * PERCENT // 100)


def prefix_size(n: int, percent: int) -> int:
    return min(n, max(n - least_overlap(n) + 1, -(-n * percent // 100)))


def least_hits(n: int, percent: int) -> int:
    """Of the prefix of a set of n, how many n-grams a linked partner has in its own prefix at least.

    Of two linked sets of n and b, the one whose prefix ends first in the order has all of it looked at by the other, but for what the other lacks. If that is the set, the partner lacks a fifth of n at most; if the partner, its prefix less what the set lacks is percent * b - (5 * b - 4 * n) / 9, which is more for every b from 0.8 * n to 1.25 * n.
    """
    return -(-n * (percent - 100 + PERCENT) // 100)


def class_key(grams: np.ndarray) -> bytes:
    """A set's identity: 128 bits of a hash over its sorted n-gram hashes."""
    return xxhash.xxh3_128_digest(grams.tobytes(), seed=len(grams))


def short_key(grams: np.ndarray) -> int:
    """Half of a set's identity, to tell apart the sets that share an n-gram, and those of rows that share an id."""
    return int.from_bytes(class_key(grams)[:8], "big") >> 1


def _meta(batches):
    """Of each text the size and identity of its set, and the set's prefix for the first search, hashes cut short: they only prune. One pass over the texts gives it all, as making the sets is most of the work."""
    for b in slices(batches):
        sets = [shingle_set(t, SHINGLE) for t in b.column(1).to_pylist()]
        own = [(s[: prefix_size(len(s), FIRST)] >> np.uint64(64 - KEY_BITS)) for s in sets]
        columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([class_key(s) for s in sets], pa.binary()), pa.array([short_key(s) for s in sets], pa.int64()), pa.array([least_hits(len(s), FIRST) for s in sets], pa.int32()), lists(own, pa.int64())]
        yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "n_shingles", "class", "short", "least", "keys"])


def _second(table, percent: int):
    """Prefixes of the sets that pass the filter; with 100 percent the sets."""

    def run(batches):
        bits = table.value
        for b in batches:
            for b in slices([passing(b, bits, 2)]):  # noqa: B020, PLW2901
                sets = [shingle_set(t, SHINGLE) for t in b.column(1).to_pylist()]
                own = [s[: prefix_size(len(s), percent)].astype(np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([short_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([least_hits(len(s), percent) for s in sets], pa.int32()), lists(own, pa.int64())], ["doc_id", "short", "n", "least", "grams"])

    return run


def needed(n: Column) -> Column:
    return F.ceil(n * PERCENT / 100)


def linkable(small: Column, other: Column) -> Column:
    return F.least(small, other) * 100 >= F.greatest(small, other) * PERCENT


def chosen_sets(src: DataFrame, chosen: DataFrame, percent: int) -> DataFrame:
    """(id, n, least, grams) of the classes in ``chosen`` (doc_id, short), one row each. Texts stay where they are read; a filter of fixed size lets few others through to the join."""
    table = src.sparkSession.sparkContext.broadcast(id_filter(chosen.select("doc_id")))
    sets = src.withColumn("place", id_place(F.col("doc_id"))).mapInArrow(_second(table, percent), "doc_id bigint, short bigint, n int, least int, grams array<bigint>")
    own = sets.join(chosen, ["doc_id", "short"], "left_semi").groupBy("doc_id", "short").agg(F.first("n").alias("n"), F.first("least").alias("least"), F.first("grams").alias("grams"))
    return own.select(F.col("doc_id").alias("id"), "short", "n", "least", "grams")


def overlaps(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    """(a, b, na, nb, overlap) of ``pairs`` (a, b): partial overlaps counted a fragment, summed a pair."""
    left = fragments.select(F.col("id").alias("a"), F.col("n").alias("na"), "fragment", F.col("grams").alias("ga"))
    right = fragments.select(F.col("id").alias("b"), F.col("n").alias("nb"), "fragment", F.col("grams").alias("gb"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("c"))
    return partial.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("overlap"))


def linked(counts: DataFrame) -> DataFrame:
    return counts.where(F.col("overlap") * 100 >= (F.col("na") + F.col("nb") - F.col("overlap")) * PERCENT).select("a", "b")


def must_share(n: Column, other: Column) -> Column:
    """What two linked sets share at least."""
    return F.ceil((n + other) * PERCENT / (100 + PERCENT))


def candidates(prefixes: DataFrame) -> DataFrame:
    """(doc_id, short) of the classes of which enough first n-grams recur in other classes."""
    full = prefixes.where("n_shingles > 0 and doc_id is not null")
    shared = full.select("short", F.explode("keys").alias("key")).groupBy("key").agg(F.min("short").alias("lo"), F.max("short").alias("hi")).where("lo <> hi").select("key")
    hits = full.select("doc_id", "least", F.explode("keys").alias("key")).join(shared, "key").groupBy("doc_id", "least").agg(F.count(F.lit(1)).alias("hits")).where("hits >= least").select("doc_id").distinct()
    return full.groupBy("class", "short").agg(F.min("doc_id").alias("doc_id")).join(hits, "doc_id", "left_semi").select("doc_id", "short")


def joined_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) once ``links`` (a, b) join some of the components in ``labels``, and nodes that have none yet."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    ends = checkpointed(links.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("of_a", "a").alias("of_a"), F.coalesce("of_b", "b").alias("of_b")))
    joined = components(ends.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))).withColumnRenamed("node", "old").withColumnRenamed("component", "new")
    old = labels.select("node", F.col("component").alias("old")).union(ends.select("a", "of_a")).union(ends.select("b", "of_b")).distinct()
    return checkpointed(old.join(joined, "old", "left").select("node", F.coalesce("new", "old").alias("component")))


def shingle_links(src: DataFrame, prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``prefixes``, as ``_meta`` gives them, whose folder is removed once read: (links (a, b) between classes that join all linked ones, components (node, component) of the linked classes); a class goes by its smallest id."""
    src = src.where("doc_id is not null")
    chosen = checkpointed(candidates(prefixes))
    forget(prefixes)
    tokens = chosen_sets(src, chosen, SECOND).select("id", "short", "n", "least", F.explode("grams").alias("gram"))
    common = tokens.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = tokens.join(common, "gram").groupBy("id", "short", "n", "least").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("r")).where("size(r) >= least")
    prefix = checkpointed(ranked.select("id", "short", "n", F.size("r").alias("m"), F.explode(F.expr("slice(r, 1, size(r) - least + 1)")).alias("g")).select("id", "short", "n", "m", F.col("g.gram").alias("gram")))
    left = checkpointed(prefix.select(F.col("id").alias("doc_id"), "short").distinct())
    sets = written(chosen_sets(src, left, 100).select("id", "n", F.posexplode(F.array(*[F.expr(f"filter(grams, g -> shiftrightunsigned(g, 62) = {k})") for k in range(FRAGMENTS)])).alias("fragment", "grams")), "shingles")
    rows = checkpointed(ranked_prefixes(sets))
    hub = rows.groupBy("gram").agg(F.max(F.struct((F.col("m") / F.col("n")).alias("share"), (-F.col("id")).alias("id"), "n")).alias("hub"), F.count(F.lit(1)).alias("k")).where("k > 1").select("gram", (-F.col("hub.id")).alias("hub"), F.col("hub.n").alias("nh"))
    rows = rows.join(hub, "gram")
    stars = rows.where(F.col("id") != F.col("hub")).where(linkable(F.col("n"), F.col("nh")) & (F.col("m") - F.col("place") >= must_share(F.col("n"), F.col("nh")))).select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    counts = checkpointed(overlaps(stars, sets))
    links = checkpointed(linked(counts))
    labels = components(links)
    # What a class shares with the hub of an n-gram, and how many more of its n-grams recur, bound what two classes there share.
    known = counts.select(F.col("a").alias("id"), F.col("b").alias("hub"), "overlap").union(counts.select(F.col("b"), F.col("a"), "overlap"))
    labelled = rows.join(labels.withColumnRenamed("node", "id"), "id", "left").join(known, ["id", "hub"], "left").select("id", "n", "m", "place", "gram", F.coalesce("component", "id").alias("label"), F.when(F.col("id") == F.col("hub"), F.col("n").cast("bigint")).otherwise(F.col("overlap")).alias("o"))
    apart = labelled.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("gram")
    open_ = checkpointed(labelled.join(apart, "gram"))
    other = open_.select("gram", *[F.col(c).alias(f"{c}_b") for c in ("id", "n", "m", "place", "label", "o")])
    need = must_share(F.col("n"), F.col("n_b"))
    by_hub = F.coalesce(F.least(F.col("o"), F.col("o_b")) + F.least(F.col("m") - F.col("o"), F.col("m_b") - F.col("o_b")), need)
    by_hub = F.when(F.col("o").isNull() | F.col("o_b").isNull(), need).otherwise(by_hub)
    by_place = F.least(F.col("m") - F.col("place"), F.col("m_b") - F.col("place_b"))
    meet = (F.col("id") < F.col("id_b")) & (F.col("label") != F.col("label_b")) & linkable(F.col("n"), F.col("n_b")) & (by_place >= need) & (by_hub >= need)
    rest = open_.join(other, "gram").where(meet).select(F.col("id").alias("a"), F.col("id_b").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    more = checkpointed(linked(overlaps(rest, sets)))
    return links.union(more), labels if more.isEmpty() else joined_components(labels, more)


def ranked_prefixes(sets: DataFrame) -> DataFrame:
    """(id, n, m, place, gram): of each whole set, by how many classes have each n-gram, the recurring ones down to the place where fewer are left than a partner must share; m of them recur. Sets of which too few recur are dropped."""
    tokens = sets.select("id", "n", F.explode("grams").alias("gram"))
    common = tokens.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = tokens.join(common, "gram").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("r")).where(F.size("r") >= needed(F.col("n")))
    return ranked.select("id", "n", F.size("r").alias("m"), F.posexplode(F.slice("r", F.lit(1), F.size("r") - needed(F.col("n")).cast("int") + 1)).alias("place", "g")).select("id", "n", "m", "place", F.col("g.gram").alias("gram"))


def shingle_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row.

    Two documents are linked when 100 * shared >= 80 * united over their distinct 5-word shingles (lower-cased A-Z; fewer words are one shingle as a whole). component_id is the smallest id reachable, a document's own included. Texts that are null or without words have an empty set and are linked with nothing; a row with a null id has the component that equal and linked texts give it, or null; repeated rows share one verdict; an empty table gives no rows.
    """
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    prefixes = written(src.mapInArrow(_meta, "doc_id bigint, n_shingles bigint, class binary, short bigint, least int, keys array<bigint>"), "prefixes")
    meta = written(prefixes.select("doc_id", "n_shingles", "class"), "classes")
    _, labels = shingle_links(src, prefixes)
    full = meta.where("n_shingles > 0")
    classes = full.groupBy("class").agg(F.min("doc_id").alias("id")).join(labels.withColumnRenamed("node", "id"), "id", "left")
    named = classes.select("class", F.xxhash64("class").alias("spread"), F.coalesce("component", "id").alias("component_id"))
    linked = full.withColumn("spread", F.xxhash64("class")).join(named, ["class", "spread"]).select("doc_id", "n_shingles", "component_id")
    return linked.union(meta.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest; rows with a null id stay."""
    kept = shingle_components(docs.where("doc_id is not null")).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(docs.columns).unionByName(docs.where("doc_id is null"))


def op2_shingle_join(spark, sf_dir: str) -> DataFrame:
    return shingle_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
