"""Personal data: patterns, and terms that disclose what the patterns find.

Patterns give the base spans. Their matches are the protected entities. How strongly a term reveals an entity is its pointwise mutual information with it over the corpus, as a share of the entity's own information content: 1 where the term never stands without the entity; an entity of a single document is disclosed by the terms that hardly any other has. Terms over a disclosure threshold are spans too, in every text that holds them; in the sanitised text base spans give way to their kind, strongly disclosing terms are removed, and others generalised.

Everything is DataFrame expressions. Java's loops over groups recurse on long matches unless possessive, and its scans are quadratic on long runs unless a match may only begin where a run does; the patterns below differ from the plain ones in that alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Kinds in their order: (pattern, cheap test that a text may have it).
PATTERNS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(text, '@')"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"text rlike '[0-9]\\.[0-9]++\\.[0-9]++\\.[0-9]'"),
    "card": (r"[0-9]++(?:[\x20-][0-9]++)*+", r"text rlike '[0-9](?:[\\x20-]?[0-9]){11}'"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"text rlike '\\+[0-9]'"),
}
VALID = {
    "email": "true",
    "ip": r"x rlike '^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\\.|$)){4}$'",
    "card": "length(regexp_replace(x, '[^0-9]', '')) between 12 and 19 and luhn_check(regexp_replace(x, '[^0-9]', ''))",
    "phone": "length(regexp_replace(x, '[^0-9]', '')) between 9 and 15",
}
#: Shares of an entity's information from which a term discloses it, and is removed.
DISCLOSED, REMOVED = 0.9, 0.999
#: Bytes of terms up to which a join sends them to all workers; beyond, it shuffles.
SENT = 16 << 20
SPANS = "array<struct<start:int,k:int,kind:string,end:int,x:string>>"


def _placed(text: str, pattern: str) -> str:
    """SQL: the matches of a pattern in order, with their places: what lies between them is what a split leaves."""
    return f"""aggregate(arrays_zip(slice(split({text}, {pattern}, -1), 1, size(split({text}, {pattern}, -1)) - 1), regexp_extract_all({text}, {pattern}, 0)),
      named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int,x:string>>)),
      (s, m) -> named_struct('at', s.at + length(m['0']) + length(m['1']), 'out', array_append(s.out, named_struct('start', s.at + length(m['0']), 'end', s.at + length(m['0']) + length(m['1']), 'x', m['1']))),
      s -> s.out)"""


def _spans(kind: str, k: int) -> str:
    pattern, test = PATTERNS[kind]
    literal = "r'" + pattern + "'"
    valid = VALID[kind].replace("x", "m.x", 1) if kind == "ip" else VALID[kind].replace("(x,", "(m.x,")
    return f"case when {test} then transform(filter({_placed('text', literal)}, m -> {valid}), m -> named_struct('start', m.start, 'k', {k}, 'kind', '{kind}', 'end', m.end, 'x', m.x)) else cast(array() as {SPANS}) end"


def base_spans(src: DataFrame) -> DataFrame:
    """``src`` (with a non-null ``text``) and ``base``: valid matches in order of start, then kind."""
    for k, kind in enumerate(PATTERNS):
        src = src.withColumn(f"__{kind}", F.expr(_spans(kind, k)))
    found = src.withColumn("base", F.array_sort(F.concat(*[f"__{k}" for k in PATTERNS])))
    return found.drop(*[f"__{k}" for k in PATTERNS])


def joined(spans: str) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{3,}+"), 0))


def disclosing(src: DataFrame, named: DataFrame) -> DataFrame:
    """(entity, term, share): terms whose mutual information with an entity is at least DISCLOSED of what the entity says.

    ``named`` are the texts with entities. Everything is counted over the rows of ``src``, so that copies of a text change no share.
    """
    n = src.count()
    texts = named.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"), F.first("base").alias("base"))
    mentions = texts.select("key", "copies", F.explode(F.array_distinct(F.expr("transform(base, s -> concat(s.kind, ' ', lower(s.x)))"))).alias("entity"))
    entities = mentions.groupBy("entity").agg(F.sum("copies").alias("df_e")).where(F.col("df_e") < n)
    terms = src.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_t"))
    beside = texts.select("key", F.explode(terms_of(F.col("text"))).alias("term")).join(terms, "term")
    reach = F.pow(F.col("df_e").cast("double"), 1 - DISCLOSED) * F.pow(F.lit(float(max(n, 2))), DISCLOSED)
    near = F.col("df_t") * reach <= F.col("df_e") * F.lit(float(n)) * (1 + 1e-9)  # no other term has the share, even if it is beside the entity each time
    pairs = mentions.join(entities, "entity").withColumnRenamed("key", "of").join(beside, (F.col("of") == F.col("key")) & near)
    pairs = pairs.groupBy("entity", "df_e", "term", "df_t").agg(F.sum("copies").alias("df_te"))
    pmi = F.log2(F.col("df_te") * F.lit(float(n)) / (F.col("df_t") * F.col("df_e")))
    share = pmi / F.log2(F.lit(float(max(n, 2))) / F.col("df_e"))
    return pairs.select("entity", "term", share.alias("share")).where(F.col("share") >= DISCLOSED)


def _sent(table: DataFrame, column: str) -> DataFrame:
    """A table that joins are to send to all workers while it is small."""
    size = table.agg(F.coalesce(F.sum(F.octet_length(column) + 16), F.lit(0))).first()[0]
    return F.broadcast(table) if size <= SENT else table


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, base, spans) for every row: base spans, and with them the spans of disclosing terms, whether or not the text names what they disclose, by start, then kind.

    A term is a whole run of letters, in any case. Null texts are empty and have no spans; null ids and repeated rows are rows like others; an empty table gives no rows. Places count code points, ends are exclusive.
    """
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = base_spans(src)
    found = found.withColumn("key", F.xxhash64("text"))
    terms = written(disclosing(src, found.where("size(base) > 0")).groupBy("term").agg(F.max("share").alias("share")), "terms")
    held = src.select(F.xxhash64("text").alias("key"), F.explode(terms_of(F.col("text"))).alias("term")).join(_sent(terms, "term"), "term")
    words = written(held.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("term")), "|").alias("terms"), F.expr("array_join(array_sort(collect_set(term) filter (where share >= %s)), '|')" % REMOVED).alias("gone")), "held")
    pattern = r"concat('(?iu)(?<!\\p{L})(?:', terms, ')(?!\\p{L})')"
    kind = r"case when x.x rlike concat('(?iu)^(?:', gone, ')$') and gone <> '' then 'remove' else 'generalise' end"
    more = F.expr(f"case when terms is null then cast(array() as {SPANS}) else transform({_placed('text', pattern)}, x -> named_struct('start', x.start, 'k', 4, 'kind', 'term', 'end', x.end, 'x', {kind})) end")
    return found.join(_sent(words, "terms"), "key", "left").withColumn("more", more).select("doc_id", "text", "base", F.array_sort(F.concat("base", "more")).alias("spans"))


def sanitised(spans: DataFrame) -> DataFrame:
    """(doc_id, text): base spans give way to [KIND], disclosing terms to [TERM] or to nothing; of overlapping spans the first counts."""
    label = "case when s.kind <> 'term' then concat('[', upper(s.kind), ']') when s.x = 'remove' then '' else '[TERM]' end"
    text = f"""aggregate(spans, named_struct('at', 0, 'out', ''), (a, s) -> case when s.start < a.at then a else named_struct('at', s.end, 'out', concat(a.out, substr(text, a.at + 1, s.start - a.at), {label})) end, a -> concat(a.out, substr(text, a.at + 1)))"""
    return spans.select("doc_id", F.expr(text).alias("text"))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    spans = pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in PATTERNS]
    return spans.select("doc_id", *n, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
