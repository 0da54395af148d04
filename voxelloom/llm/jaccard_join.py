"""n-gram Jaccard self-join of whole texts by chosen paths.

Each text is a set of word shingles. Texts with equal sets form a class; one representative of
each class joins. A run samples FAN coordinates at the root and puts every representative into the
bucket of its minimum-hash shingle there: two sets share it with a probability of their Jaccard
similarity. A large bucket whose members mostly differ is split again on further sampled
coordinates of its own; small buckets, and dense ones (near copies, which no token tells apart),
are leaves. Runs repeat until a pair at the threshold is missed with a probability below
1 - recall.

Leaves are compared by brute force on whole shingle sets. A pair belongs to the first leaf that
holds both its ends, so it counts once. A big leaf is compared tile by tile: no leaf's size has a
cap, and no list of its pairs is ever made, since a tile pair returns counts and a spanning forest.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, prepare, tidy
from .graph import Forest, components
from .textkeys import mix64, shingles, word_hashes

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999999
FAN = 3
DEPTH = 3
COORDS = 32
SMALL_BUCKET = 1000
DENSE = 0.4
TILE = 1024
BLOCK = 256
COLUMNS = 8192


def runs_for(threshold: float, recall: float, fan: int = FAN, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold is found with that probability, at any depth."""
    p = 1.0
    for _ in range(depth):
        p = 1 - (1 - threshold * p) ** fan
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


# --- sets and signatures ---------------------------------------------------------------------


def _signatures(words: int, coords: int):
    salts = mix64(np.arange(1, coords + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def run(batches):
        for batch in batches:
            for row, hashes, bounds in word_hashes(batch.column("text")):
                sh, at = shingles(hashes, bounds, words)
                n = len(at) - 1
                k1, k2, size = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
                sig = np.zeros((n, coords), np.uint32)
                full = np.flatnonzero(np.diff(at) > 0)
                for i in full.tolist():
                    own = np.unique(sh[at[i] : at[i + 1]])
                    size[i] = len(own)
                    k1[i] = np.bitwise_xor.reduce(mix64(own + np.uint64(7))).astype(np.int64)
                    k2[i] = np.add.reduce(mix64(own ^ np.uint64(0xABCDEF))).astype(np.int64)
                if len(full):
                    for c in range(coords):
                        sig[full, c] = (np.minimum.reduceat(sh * salts[c], at[full]) >> np.uint64(24)).astype(np.uint32)
                packed = sig.tobytes()
                width = 4 * coords
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, n), batch.column("addr").slice(row, n), pa.array(k1), pa.array(k2), pa.array(size), pa.array([packed[i * width : (i + 1) * width] for i in range(n)], pa.binary())],
                    names=["doc_id", "addr", "k1", "k2", "size", "sig"],
                )

    return tidy(run)


def _addressed(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("addr", F.xxhash64("doc_id", "text"))


BLOOM_BITS_EACH, BLOOM_MOST_BITS = 16, 1 << 27


def _bits(addr: np.ndarray, bits: int) -> np.ndarray:
    x = addr.view(np.uint64)
    return (np.stack([mix64(x ^ np.uint64(k * 77 + 1)) for k in range(4)]) & np.uint64(bits - 1)).astype(np.int64)


def _bloom_words(bits: int):
    def run(batches):
        words = np.zeros(bits >> 5, np.uint32)
        for batch in batches:
            at = _bits(batch.column("addr").to_numpy(), bits).ravel()
            np.bitwise_or.at(words, at >> 5, np.uint32(1) << (at & 31).astype(np.uint32))
        used = np.flatnonzero(words)
        for i in range(0, len(used), 1 << 16):
            part = used[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(words[part].astype(np.int64))], names=["word", "bits"])

    return tidy(run)


def bloom_filter(wanted: DataFrame):
    """A Bloom filter of wanted(addr), at most BLOOM_MOST_BITS long: a scan can drop most other rows
    before they would be shuffled to the join that decides."""
    n = wanted.count()
    bits = min(BLOOM_MOST_BITS, 1 << max(10, (BLOOM_BITS_EACH * n).bit_length()))
    rows = wanted.mapInArrow(_bloom_words(bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(bits >> 5, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return bits, out


def _in_filter(bloom):
    """A function of a column of addresses: whether the filter has them."""

    @F.pandas_udf("boolean")
    def run(addr: pd.Series) -> pd.Series:
        bits, filled = bloom.value
        at = _bits(addr.to_numpy(np.int64), bits)
        return pd.Series(((filled[at >> 5] >> (at & 31)) & 1).all(0).astype(bool))

    return run


def _sets(words: int, bloom):
    """(addr, text) -> (addr, set) where the filter has addr: the sorted distinct shingle hashes as bytes."""

    def run(batches):
        bits, filled = bloom.value
        for batch in batches:
            at = _bits(batch.column("addr").to_numpy(), bits)
            batch = batch.filter(pa.array(((filled[at >> 5] >> (at & 31)) & 1).all(0)))
            if not batch.num_rows:
                continue
            for row, hashes, bounds in word_hashes(batch.column("text")):
                sh, at = shingles(hashes, bounds, words)
                n = len(at) - 1
                yield pa.RecordBatch.from_arrays([batch.column("addr").slice(row, n), pa.array([np.unique(sh[at[i] : at[i + 1]]).tobytes() for i in range(n)], pa.binary())], names=["addr", "set"])

    return tidy(run)


# --- chosen paths ----------------------------------------------------------------------------


def _children(picks: int, coords: int, root: bool):
    """(node, addr, sig) -> (node, child, addr) for the coordinates that the node samples.

    The root takes the first `picks` of the random coordinates; any other node an odd stride from a
    start of its own, so that its coordinates differ.
    """

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(n, coords)
            node = batch.column("node").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for k in range(picks):
                if root:
                    col = np.full(n, k, np.int64)
                else:
                    col = ((mix64(node) + (mix64(node ^ np.uint64(99)) | np.uint64(1)) * np.uint64(k)) % np.uint64(coords)).astype(np.int64)
                value = sig[np.arange(n), col].astype(np.uint64)
                child = mix64(mix64(node + np.uint64(0x1234567)) ^ mix64(col.astype(np.uint64) << np.uint64(32) | value))
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(child.view(np.int64)), batch.column("addr")], names=["node", "child", "addr"])

    return tidy(run)


def leaves(reps: DataFrame, runs: int, fan: int = FAN, coords: int = COORDS, depth: int = DEPTH, small: int = SMALL_BUCKET, dense: float = DENSE) -> DataFrame:
    """reps(addr, sig) -> (bucket, n, addr): all leaves of two or more members."""
    schema = "node long, child long, addr long"
    roots = reps.select(F.lit(0).cast("long").alias("node"), "addr", "sig")
    level = roots.mapInArrow(_children(runs * fan, coords, True), schema).select(F.col("child").alias("node"), "addr")
    level = materialise(level, "paths-root")
    out = None
    for d in range(depth):
        counts = level.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        level = materialise(level.join(counts, "node"), f"paths-{d}")
        large = level.where(F.col("n") > small)
        last = d == depth - 1 or not large.take(1)
        leaf = level if last else level.where(F.col("n") <= small)
        out = leaf if out is None else out.unionByName(leaf)
        if last:
            break
        split = large.select("node", "addr").join(reps.select("addr", "sig"), "addr").select("node", "addr", "sig")
        split = materialise(split.mapInArrow(_children(fan, coords, False), schema), f"split-{d}")
        sizes = split.groupBy("node", "child").agg(F.count("*").cast("double").alias("c"))
        agree = sizes.groupBy("node").agg((F.sum(F.col("c") * F.col("c")) * fan / (F.sum("c") * F.sum("c"))).alias("agree"))
        agree = materialise(agree, f"agree-{d}")
        out = out.unionByName(large.join(agree.where(F.col("agree") >= dense).select("node"), "node").select(*leaf.columns))
        level = split.join(agree.where(F.col("agree") < dense).select("node"), "node").select(F.col("child").alias("node"), "addr")
    return out.select(F.col("node").alias("bucket"), "n", "addr")


# --- brute force in leaves -------------------------------------------------------------------


def _grouped(batches, keys: list[str]):
    """Tables of equal keys from batches that are sorted by them."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        change = np.zeros(t.num_rows, bool)
        for k in keys:
            v = t.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        if held and any(held[-1].column(k)[-1].as_py() != t.column(k)[0].as_py() for k in keys):
            yield pa.concat_tables(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), t.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            held.append(t.slice(a, b - a))
            if b < t.num_rows:
                yield pa.concat_tables(held) if len(held) > 1 else held[0]
                held = []
    if held:
        yield pa.concat_tables(held)


def _blocks(side: np.ndarray, step: int = BLOCK):
    """Index blocks to compare: side 2 with itself, side 0 with side 1."""
    own, a, b = (np.flatnonzero(side == s) for s in (2, 0, 1))
    for i in range(0, len(own), step):
        for j in range(i, len(own), step):
            yield own[i : i + step], own[j : j + step]
    for i in range(0, len(a), step):
        for j in range(0, len(b), step):
            yield a[i : i + step], b[j : j + step]


def _common(lists: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """How many values each row list shares with each column list."""
    both = [lists[i] for i in rows] + [lists[j] for j in cols]
    lens = np.fromiter(map(len, both), np.int64, len(both))
    out = np.zeros((len(rows), len(cols)), np.float32)
    if not lens.sum():
        return out
    values, inverse, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(both)), lens)
    # Only values on both sides count; they are worked through in bounded blocks of columns.
    left = np.zeros(len(values), bool)
    right = np.zeros(len(values), bool)
    left[inverse[owner < len(rows)]] = True
    right[inverse[owner >= len(rows)]] = True
    keep = left & right & (count > 1)
    place = np.cumsum(keep) - 1
    use = keep[inverse]
    at, who = place[inverse[use]], owner[use]
    order = np.argsort(at, kind="stable")
    at, who = at[order], who[order]
    for c in range(0, int(keep.sum()), COLUMNS):
        lo, hi = np.searchsorted(at, [c, c + COLUMNS])
        m = np.zeros((len(both), min(COLUMNS, int(keep.sum()) - c)), np.float32)
        m[who[lo:hi], at[lo:hi] - c] = 1
        out += m[: len(rows)] @ m[len(rows) :].T
    return out


def _new_pairs(bucket: int, size, paths, rows, cols, threshold: float) -> np.ndarray:
    """Which pairs have sizes that allow the threshold and no earlier leaf in common."""
    a, b = size[rows][:, None], size[cols][None, :]
    ok = np.minimum(a, b) >= threshold * np.maximum(a, b)
    if rows[0] == cols[0]:
        ok &= rows[:, None] < cols[None, :]
    if ok.any():
        ok &= _common(paths, rows, cols) == 0
    return ok


def _read(t: pa.Table):
    bucket = t.column("bucket")[0].as_py()
    size, side = t.column("size").to_numpy(), t.column("side").to_numpy()
    paths = [p[p < bucket] for p in (np.frombuffer(x, np.int64) for x in t.column("paths").to_pylist())]
    return bucket, size, side, paths


def least_agreement(threshold: float, recall: float, coords: int = COORDS) -> int:
    """The most equal coordinates that a pair at the threshold misses with at most 1 - recall."""
    tail = 0.0
    for k in range(coords + 1):
        tail += math.comb(coords, k) * threshold**k * (1 - threshold) ** (coords - k)
        if tail > 1 - recall:
            return k
    return coords


def _mark(threshold: float, agree: int, coords: int = COORDS):
    """Keeps the members of each tile pair that have a pair to verify there.

    Besides its sizes a pair must have enough equal coordinates, by one byte of each.
    """

    def run(batches):
        for t in _grouped(batches, ["bucket", "pair"]):
            bucket, size, side, paths = _read(t)
            marks = np.frombuffer(b"".join(t.column("marks").to_pylist()), np.uint8).reshape(-1, coords)
            hit = np.zeros(t.num_rows, bool)
            for rows, cols in _blocks(side):
                ok = _new_pairs(bucket, size, paths, rows, cols, threshold)
                if ok.any():
                    ok &= np.count_nonzero(marks[rows][:, None, :] == marks[cols][None, :, :], axis=2) >= agree
                hit[rows] |= ok.any(1)
                hit[cols] |= ok.any(0)
            if hit.any():
                yield from t.filter(pa.array(hit)).drop_columns(["marks"]).combine_chunks().to_batches()

    return tidy(run)


def _verify(threshold: float):
    """Exact comparison: per member of a tile pair its weighted links and the root of its tree."""

    def run(batches):
        for t in _grouped(batches, ["bucket", "pair"]):
            bucket, size, side, paths = _read(t)
            addr, weight = t.column("addr").to_numpy(), t.column("copies").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
            links = np.zeros(len(addr), np.int64)
            forest = Forest(len(addr))
            for rows, cols in _blocks(side):
                ok = _new_pairs(bucket, size, paths, rows, cols, threshold)
                many = int(ok.sum())
                if not many:
                    continue
                if many <= 2 * (len(rows) + len(cols)):
                    for i, j in zip(*np.nonzero(ok), strict=True):
                        a, b = sets[rows[i]], sets[cols[j]]
                        inter = len(np.intersect1d(a, b, assume_unique=True))
                        ok[i, j] = inter >= threshold * (len(a) + len(b) - inter)
                else:
                    inter = _common(sets, rows, cols).astype(np.float64)
                    ok &= inter >= threshold * (size[rows][:, None] + size[cols][None, :] - inter)
                if not ok.any():
                    continue
                np.add.at(links, rows, ok @ weight[cols])
                np.add.at(links, cols, weight[rows] @ ok)
                forest.link(ok, rows, cols)
            on = np.flatnonzero(links)
            if len(on):
                yield pa.RecordBatch.from_arrays([pa.array(addr[on]), pa.array(links[on]), pa.array(addr[[forest.find(int(i)) for i in on]])], names=["addr", "links", "root"])

    return tidy(run)


# --- the operator ----------------------------------------------------------------------------


def join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE, small: int = SMALL_BUCKET) -> DataFrame:
    """Per row of docs(doc_id, text, ...): doc_id, n_links, class_id, kept, and its address addr.

    n_links counts the other rows whose shingle sets have a Jaccard similarity of the threshold or
    more, copies included; class_id is the smallest doc_id that links reach; kept is true on the
    rows that stand for their class (smallest id, then address; equal rows share both).

    Edge cases: null and empty texts, and texts without words, have no set, link with nothing and
    are kept; a text of fewer words than a shingle is one shingle; a null id is greater than any
    other; repeated rows are copies of each other; an empty table gives an empty result; further
    columns aren't read.
    """
    spark = prepare(docs.sparkSession)
    part = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = runs_for(threshold, recall)
    if runs * FAN > COORDS:
        raise ValueError("more root coordinates than hashes: raise COORDS")
    rows = materialise(_addressed(docs).mapInArrow(_signatures(words, COORDS), "doc_id long, addr long, k1 long, k2 long, size long, sig binary"), "sets")
    reps = rows.where("size > 0").groupBy("k1", "k2").agg(F.min(F.struct("addr", "size", "sig")).alias("r"), F.count("*").alias("copies"))
    reps = materialise(reps.select("k1", "k2", "r.addr", "r.size", "r.sig", "copies"), "classes")

    leaf = materialise(leaves(reps.select("addr", "sig"), runs, small=small), "leaves")
    # The paths of a representative: at most runs x FAN ** DEPTH.
    paths = leaf.groupBy("addr").agg(F.sort_array(F.collect_set("bucket")).alias("path"))
    paths = paths.join(reps.select("addr", "size", "copies", "sig"), "addr").mapInArrow(tidy(_pack_paths), "addr long, size long, copies long, paths binary, marks binary")
    tiles = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    own = F.pmod(F.xxhash64("addr", "bucket"), tiles).cast("int")
    spread = leaf.join(materialise(paths, "paths"), "addr").withColumn("tiles", tiles).withColumn("own", own)
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pair = F.least("own", "other").cast("long") * F.col("tiles") + F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    spread = spread.select("bucket", pair.alias("pair"), side.alias("side"), "addr", "size", "copies", "paths", "marks")
    schema = "bucket long, pair long, side int, addr long, size long, copies long, paths binary"
    spread = spread.repartition(part, "bucket", "pair").sortWithinPartitions("bucket", "pair", "addr")
    marked = materialise(spread.mapInArrow(_mark(threshold, least_agreement(threshold, recall)), schema), "to-verify")

    wanted = materialise(marked.select("addr").distinct(), "texts-to-verify")
    bloom = spark.sparkContext.broadcast(bloom_filter(wanted))
    sets = _addressed(docs).select("addr", "text").mapInArrow(_sets(words, bloom), "addr long, set binary").join(wanted, "addr")
    sets = sets.groupBy("addr").agg(F.first("set").alias("set"))  # equal rows have one address
    ready = marked.join(sets, "addr").repartition(part, "bucket", "pair").sortWithinPartitions("bucket", "pair", "addr")
    found = materialise(ready.mapInArrow(_verify(threshold), "addr long, links long, root long"), "links")

    degree = found.groupBy("addr").agg(F.sum("links").alias("links"))
    root = components(found.select(F.col("addr").alias("a"), F.col("root").alias("b")))
    classes = reps.join(degree, "addr", "left").join(root.withColumnRenamed("node", "addr"), "addr", "left")
    classes = classes.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "addr").alias("root"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "addr"))
    own_least = rows.where("size > 0").groupBy("k1", "k2").agg(least.alias("own"))
    classes = classes.join(own_least, ["k1", "k2"])
    classes = materialise(classes, "class-roots")
    tops = classes.groupBy("root").agg(F.min("own").alias("top"))
    classes = classes.join(tops, "root").select("k1", "k2", "n_links", "top")
    out = rows.where("size > 0").join(classes, ["k1", "k2"])
    out = out.select("doc_id", "n_links", F.col("top.doc_id").alias("class_id"), (F.col("addr") == F.col("top.addr")).alias("kept"), "addr")
    alone = rows.where("size = 0").select("doc_id", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"), "addr")
    return out.unionByName(alone)


def _pack_paths(batches):
    for batch in batches:
        packed = pa.array([np.array(p, np.int64).tobytes() for p in batch.column("path").to_pylist()], pa.binary())
        marks = pa.array([np.frombuffer(s, np.uint32).astype(np.uint8).tobytes() for s in batch.column("sig").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("addr"), batch.column("size"), batch.column("copies"), packed, marks], names=["addr", "size", "copies", "paths", "marks"])


def keep_one(docs: DataFrame, **kw) -> DataFrame:
    """The rows of docs that stand for their class, with all columns; of equal rows one stays.

    Null and empty texts have no class and stay, once for each id; a null id stands for a class only
    where no other does; an empty table stays empty; very long texts are compared whole.

    Rows that surely stay never meet a shuffle: a Bloom filter of the addresses in doubt (dropped, or
    of several equal rows) tells most rows apart where they are read, and a join decides on the rest.
    """
    spark = prepare(docs.sparkSession)
    decided = join(docs, **kw).groupBy("addr").agg(F.max("kept").alias("kept"), F.count("*").alias("copies"))
    decided = materialise(decided.where("not kept or copies > 1"), "in-doubt")
    bloom = spark.sparkContext.broadcast(bloom_filter(decided.select("addr")))
    # Clashing column names can't happen: what is added has made-up names.
    rows = docs.withColumn("__addr", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("__doubt", _in_filter(bloom)("__addr"))
    names = [f"`{c}`" for c in docs.columns]
    sure = rows.where("not __doubt").select(*names)
    doubt = rows.where("__doubt").join(decided.select(F.col("addr").alias("__addr"), F.col("kept").alias("__kept"), F.col("copies").alias("__copies")), "__addr", "left")
    out = sure.unionByName(doubt.where("__kept is null").select(*names))
    if not decided.where("kept").take(1):
        return out
    return out.unionByName(doubt.where("__kept").dropDuplicates(["__addr"]).select(*names))
