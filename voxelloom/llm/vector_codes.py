"""Vector codes by product quantisation, the nearest entries found through VA-files.

Vectors of integers are cut into PARTS equal parts. Every part position has a codebook of at most
ENTRIES entries, refined by ROUNDS of integer k-means. The nearest entry of a part is found as in a
VA-file: each coordinate of the entries is quantised to a cell of CELL_BITS bits; for each queried
part a lookup table gives, per coordinate and cell, the least and the greatest squared distance to
that cell; sums over the coordinates bound each entry's distance from both sides. Only entries whose
lower bound doesn't pass the least upper bound are refined with whole integer distances.

A round is one pass over the written vectors: tasks reduce their rows to sums and counts per part
and entry, Spark adds these up, and at most PARTS x ENTRIES rows of the width of a part reach the
driver, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, prepare, tidy

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
CELL_BITS = 4
#: Vectors that are looked up together: the tables and bounds of one part stay under a few MB.
AT_ONCE = 2048
#: Labels of this share of the rows count as hot: there are never more of them than this.
HOT_LABELS = 1000


def most(width: int) -> int:
    """Components saturate here, so that a part's squared distance stays a 64-bit integer."""
    return 1 << ((62 - max(1, width).bit_length()) // 2 - 1)


class Cells:
    """The entries of one part, quantised by coordinate."""

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS):
        self.entries = entries
        n, width = entries.shape
        self.cell = np.zeros((n, width), np.int64)
        self.low, self.high = [], []
        for j in range(width):
            # Cell edges at quantiles of this coordinate; each cell is kept as the range its entries span.
            values = np.sort(entries[:, j])
            firsts = np.unique(values[np.arange(1 << bits) * n >> bits])
            self.cell[:, j] = np.searchsorted(firsts, entries[:, j], "right") - 1
            ends = np.searchsorted(values, firsts[1:], "left") - 1
            self.low.append(firsts)
            self.high.append(np.append(values[ends], values[-1]))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances, queries x entries."""
        lower = np.zeros((len(queries), len(self.entries)), np.int64)
        upper = np.zeros_like(lower)
        for j, (low, high) in enumerate(zip(self.low, self.high, strict=True)):
            x = queries[:, j, None]
            under, over = low[None, :] - x, x - high[None, :]
            near = np.maximum(np.maximum(under, over), 0)
            far = np.maximum(np.abs(under), np.abs(over))
            cells = self.cell[:, j]
            lower += (near * near)[:, cells]
            upper += (far * far)[:, cells]
        return lower, upper

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (ties: the lower one) and its squared distance."""
        lower, upper = self.bounds(queries)
        row, entry = np.nonzero(lower <= upper.min(1, keepdims=True))
        gap = queries[row] - self.entries[entry]
        exact = (gap * gap).sum(1)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        best = np.minimum.reduceat(exact, first)
        # Candidates stand by row, then by index: the first that meets the least distance wins.
        hit = np.flatnonzero(exact == np.repeat(best, np.diff(np.append(first, len(row)))))
        return entry[hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]], best


def _integers(column, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, size) if len(column) else np.zeros((0, size), np.int64)


def _pack(parts: int, size: int):
    """Integer components, filled up with zeros to `size`, as bytes."""
    top = most(size // parts)

    def run(batches):
        for batch in batches:
            packed = []
            for v in batch.column("embedding").to_pylist():
                out = np.zeros(size, np.int64)
                out[: len(v)] = np.clip(np.floor(np.asarray(v, np.float64) * SCALE), -top, top)
                packed.append(out.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(packed, pa.binary())], names=["vec_id", "label", "packed"])

    return tidy(run)


def _look_up(x: np.ndarray, books: list[np.ndarray]):
    """Per part: (part, nearest entries, squared distances) of all rows of x."""
    width = x.shape[1] // len(books)
    for p, book in enumerate(books):
        cells, mine = Cells(book), x[:, p * width : (p + 1) * width]
        found = [cells.nearest(mine[i : i + AT_ONCE]) for i in range(0, len(mine), AT_ONCE)]
        yield p, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _sums(size: int, books):
    """Per task one row for each part and entry in use: count and componentwise sums."""

    def run(batches):
        entries, parts = len(books.value[0]), len(books.value)
        width = size // parts
        count = np.zeros((parts, entries), np.int64)
        total = np.zeros((parts, entries, width), object)  # Python integers: sums of any size
        for batch in batches:
            x = _integers(batch.column("packed"), size)
            if not len(x):
                continue
            for p, nearest, _ in _look_up(x, books.value):
                count[p] += np.bincount(nearest, minlength=entries)
                order = np.argsort(nearest, kind="stable")
                first = np.flatnonzero(np.diff(nearest[order], prepend=-1))
                # A batch's halves add up without overflow: |component| < 2**30, rows < 2**31.
                total[p, nearest[order[first]]] += np.add.reduceat(x[order, p * width : (p + 1) * width], first, axis=0).astype(object)
        p, e = np.nonzero(count)
        sums = [[int(s) for s in total[a, b]] for a, b in zip(p, e, strict=True)]
        kind = pa.list_(pa.decimal128(38))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(sums, kind)], names=["part", "entry", "n", "sums"])

    return tidy(run)


def _codes(size: int, books):
    def run(batches):
        for batch in batches:
            x = _integers(batch.column("packed"), size)
            codes = np.zeros((len(x), len(books.value)), np.uint8)
            error, rough = np.zeros(len(x), np.int64), np.zeros(len(x))
            if len(x):
                for p, nearest, far in _look_up(x, books.value):
                    codes[:, p] = nearest
                    error += far
                    rough += far
            fits = rough < 2.0**63
            code = [c.tobytes().hex() for c in codes]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64(), mask=~fits)], names=["vec_id", "label", "code", "error"])

    return tidy(run)


def _refined(packed: DataFrame, size: int, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: every part to its nearest entry, every entry in use to the floor of its parts' mean."""
    spark = packed.sparkSession
    width = size // len(books)
    shared = spark.sparkContext.broadcast(books)  # PARTS x ENTRIES entries at most
    rows = packed.mapInArrow(_sums(size, shared), "part int, entry int, n long, sums array<decimal(38,0)>")
    sums = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    out = [b.copy() for b in books]
    for r in rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
        out[r["part"]][r["entry"]] = [int(r[f"s{i}"]) // int(r["n"]) for i in range(width)]
    return out


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """vectors(vec_id, embedding, label, ...) -> (vec_id, label, code, error) and the codebooks, entries x width for each part.

    Rows whose vector is null or holds null or non-finite components are left out. A shorter vector
    counts as filled up with zeros to the length of the longest, and that to a multiple of `parts`;
    empty vectors are all zeros. Codebooks start as the parts of the `entries` smallest vec_ids
    (equal ids: by their components; null ids last); with fewer rows there are fewer entries.
    Repeated rows each count and each get their row. Components saturate at most(width), 2**28
    for four a part; an error beyond 64 bits is null. An empty table gives an empty result and
    codebooks without entries. Other columns aren't read.
    """
    spark = prepare(vectors.sparkSession)
    if not 1 <= entries <= 256:
        raise ValueError("an index is one byte: 1 to 256 entries")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.coalesce(F.forall("embedding", finite), F.lit(False)))
    longest = rows.agg(F.max(F.size("embedding"))).first()[0]
    size = max(1, -(-(longest or 0) // parts)) * parts
    width = size // parts
    label = rows.schema["label"].dataType.simpleString()
    packed = rows.mapInArrow(_pack(parts, size), f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {label}, packed binary")
    packed = materialise(packed, "packed-vectors")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).collect()
    start = np.zeros((len(first), size), np.int64)
    for i, r in enumerate(first):
        start[i, : len(r[0])] = np.clip(np.floor(np.asarray(r[0], np.float64) * SCALE), -most(width), most(width))
    books = [np.ascontiguousarray(start[:, p * width : (p + 1) * width]) for p in range(parts)]
    if first:
        for _ in range(rounds):
            books = _refined(packed, size, books)
    shared = spark.sparkContext.broadcast(books)
    coded = packed.mapInArrow(_codes(size, shared), f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {label}, code string, error long")
    return coded, books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame) -> DataFrame:
    """Per kept row: vec_id, code, error, label_error (null labels count as one label), codebooks_sha256.

    What encode() says of odd rows holds. A label's total is the sum of its errors that are not
    null. A label may hold any share of the rows: errors are added up per task first; the totals of
    labels that hold a HOT_LABELS-th of the rows or more, at most HOT_LABELS labels, are broadcast,
    all others are joined by label.
    """
    coded, books = encode(vectors)
    coded = materialise(coded, "vector-codes")
    key = ["name", "known"]
    coded = coded.select("vec_id", "code", "error", F.coalesce(F.col("label").cast("string"), F.lit("")).alias("name"), F.col("label").isNotNull().alias("known"))
    totals = coded.groupBy(*key).agg(F.count("*").alias("n"), F.expr("try_cast(sum(cast(error as decimal(38,0))) as bigint)").alias("label_error"))
    totals = materialise(totals, "label-errors")
    least = (totals.agg(F.sum("n")).first()[0] or 0) / HOT_LABELS
    hot, others = (totals.where(w).drop("n") for w in (F.col("n") >= least, F.col("n") < least))
    out = coded.join(F.broadcast(hot), key).unionByName(coded.join(F.broadcast(hot), key, "left_anti").join(others, key))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same by whole distances to every entry, for vectors of one length that `parts` divides."""

    def nearest(books: str, out: str) -> str:
        return f"""
{out} AS MATERIALIZED (SELECT r, p, any_value(v) AS v, min(d) AS d, arg_min(e, d * {entries} + e) AS e FROM (
   SELECT r, cut.p, cut.v, b.e, list_sum(list_transform(list_zip(cut.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
   FROM cut JOIN {books} b ON cut.p = b.p) GROUP BY r, p)"""

    steps = []
    for k in range(rounds):
        steps.append(nearest(f"book{k}", f"near{k}"))
        steps.append(
            f"""
mean{k} AS (SELECT p, e, list(m ORDER BY i) AS v FROM (
   SELECT p, e, i, (sum(x) // count(*) - CASE WHEN sum(x) % count(*) < 0 THEN 1 ELSE 0 END)::BIGINT AS m
   FROM (SELECT p, e, unnest(v) AS x, unnest(range(len(v))) AS i FROM near{k}) GROUP BY p, e, i) GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m ON b.p = m.p AND b.e = m.e)"""
        )
    steps.append(nearest(f"book{rounds}", "final"))
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT r, p, x[p * (len(x) // {parts}) + 1:(p + 1) * (len(x) // {parts})] AS v FROM kept, range({parts}) t(p)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM cut WHERE r <= {entries}),{",".join(steps)},
done AS (SELECT r, string_agg(printf('%02x', e::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM final GROUP BY r),
sums AS (SELECT label, sum(error)::BIGINT AS label_error FROM kept JOIN done USING (r) GROUP BY label)
SELECT vec_id, code, error, label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN done USING (r) JOIN sums ON kept.label IS NOT DISTINCT FROM sums.label
"""
