"""Mixing sources to target weights: hash-random keys, range sort, distributed prefix sums, exact cut.

DataFrame functions only. Inside each source the rows are ordered by a hash-random key; the key
range is cut into buckets, bucket totals give each bucket's offset (a prefix sum over a table of
sources x buckets), and a window inside one bucket gives each row's own prefix. No window ever
spans a source, so a source that holds a third of all rows is spread over all its buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

WORD = r"[^\x20\x09-\x0D]+"
KEY_BITS = 60
ROWS_PER_BUCKET = 20_000
LEAST_BUCKET_BITS = 8


def _key(id_col: str, seed: str):
    """60 random bits from md5, so that any engine can repeat the order."""
    text = F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> with target: weighted shares of share x the sum, each at most cap x its size.

    Sharing the excess again by weight until no source is above its cap gives weight x L cut at
    the cap for one level L. Sorted by cap / weight, the sources at their cap are a prefix, so L
    comes from one prefix sum of caps and one suffix sum of weights. One row per source meets in
    one task here; all else in the operator is spread.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("most") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) * F.lit(share) - before) / after
    ranked = ranked.withColumn("level", level)
    top = F.coalesce(F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole), F.max("ratio").over(whole))
    return ranked.withColumn("target", F.least(F.col("weight") * top, F.col("most"))).select("source", "source_size", "target")


def mix(
    docs: DataFrame,
    weights=(3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    carry: bool = False,
) -> DataFrame:
    """Words that the mix takes of each document of docs(doc_id, text, source, ...).

    Returns doc_id, source, size, source_size, target, taken; with carry also the struct `row` of
    all input columns. A source's budget is floor(target); whole epochs are taken of every
    document, the rest in key order until the budget is met exactly, the last document in part.

    Edge cases: null or empty text has size 0 and is taken 0 times; a null source is a source of
    its own, ranked last; null ids share one key; repeated rows and tied keys are ordered by id
    and size, equal rows being interchangeable; a source of size 0 takes nothing; an empty table
    gives an empty result; further columns are ignored unless carried.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    keyed = docs.select("doc_id", "source", size.alias("size"), _key("doc_id", seed).alias("key"))
    small = materialise(keyed, "mix-sizes")
    rows = small.count()
    bits = max(LEAST_BUCKET_BITS, math.ceil(math.log2(max(1, rows / ROWS_PER_BUCKET))))
    bucket = F.shiftright("key", KEY_BITS - bits).cast("int")
    sums = small.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size"))
    sums = materialise(sums, "mix-buckets")
    targets = source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, cap)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    offsets = materialise(
        offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select("o.source", "o.bucket", "o.offset", "t.source_size", "t.target"),
        "mix-offsets",
    )
    joined = small.withColumn("bucket", bucket).alias("d").join(offsets.alias("o"), (F.col("d.bucket") == F.col("o.bucket")) & F.col("d.source").eqNullSafe(F.col("o.source"))).select("d.*", "o.offset", "o.source_size", "o.target")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    out = joined.withColumn("epochs", epochs).withColumn("part", part.cast("long"))
    if carry:
        rows = docs.select("doc_id", "source", size.alias("size"), _key("doc_id", seed).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        out = _cut(rows, out)
    out = out.withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", *(["row"] if carry else []))


def _cut(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows(source, key, doc_id, size, row) with what parts, of the same rows without `row`, tells of each; whole rows aren't shuffled.

    In key order a source's rows are taken once more up to its last row with a part, which is cut.
    So that row's place tells the part of every other row; only rows that share it are numbered.
    """
    place = F.struct("key", "doc_id", "size")
    parts = materialise(parts.select("source", "source_size", "target", "epochs", "part", place.alias("at")), "mix-parts")
    known = ["source_size", "target", "epochs"]
    last = F.max(F.when(F.col("part") > 0, F.col("at"))).alias("edge")
    edges = materialise(parts.groupBy("source", *known).agg(last), "mix-edges")
    same = parts.alias("p").join(edges.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source")) & (F.col("p.at") == F.col("e.edge")))
    whole = F.col("p.part") == F.col("p.at.size")
    same = same.groupBy("p.source").agg(F.count("*").alias("tied"), F.count_if(whole).alias("whole"), F.coalesce(F.max(F.when(~whole, F.col("p.part"))), F.lit(0)).alias("cut"))
    named = edges.alias("e").join(same.alias("s"), F.col("e.source").eqNullSafe(F.col("s.source")), "left")
    named = materialise(named.select(F.col("e.source").alias("_source"), *known, "edge", "tied", "whole", "cut"), "mix-cuts")
    out = rows.join(named, F.col("source").eqNullSafe(F.col("_source")))
    on = F.coalesce(place == F.col("edge"), F.lit(False))
    nth = lambda n: F.when(n <= F.col("whole"), F.col("size")).when(n == F.col("whole") + 1, F.col("cut")).otherwise(F.lit(0))
    alone = out.withColumn("part", F.when(place < F.col("edge"), F.col("size")).when(on, nth(F.lit(1))).otherwise(F.lit(0)))
    if not named.where("tied > 1").take(1):
        return alone
    tied = on & (F.col("tied") > 1)
    number = F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64("row")))
    return alone.where(~tied).unionByName(out.where(tied).withColumn("_n", number).withColumn("part", nth(F.col("_n"))).drop("_n"))


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """docs as the mix takes them: one row for each epoch, the last one cut to the words taken.

    A document cut by its source's budget keeps its first words, joined by single spaces; at most
    one document of each source is cut in an epoch. Documents that the mix doesn't take go: among
    them null, empty and blank texts, which have no words. Null ids and sources are mixed like
    others, repeated rows each for itself; an empty table gives none; further columns are carried.
    """
    taken = mix(docs, carry=True, **kw).where("taken > 0")
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    words = (F.col("taken") - whole * F.col("size")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(-1), whole), F.when(words > 0, F.array(words)).otherwise(F.array().cast("array<int>")))
    rows = taken.select("row", F.explode(copies).alias("words"))
    cut = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)), 1, F.col("words")), " ")
    text = F.when(F.col("words") < 0, F.col("row.text")).otherwise(cut)
    cols = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.col("words") < 0, F.col("row.n_chars")).otherwise(F.char_length(cut)).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[e.alias(c) for c, e in cols.items()])


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)]::DOUBLE AS weight FROM s),
c AS (SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / weight AS ratio FROM r),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
         - coalesce(sum(most) OVER (ORDER BY ratio, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY ratio, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, source_size, least(weight * coalesce(max(CASE WHEN level <= ratio THEN level END) OVER (), max(ratio) OVER ()), most) AS target FROM l),
p AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        floor(t.target)::BIGINT AS budget
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, source, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM e
"""
