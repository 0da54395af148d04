"""Benchmark decontamination by latent semantic retrieval.

Terms are the words of the benchmark; their inverse document frequencies are counted over all
documents. A distributed randomised SVD of the TF-IDF passages of all documents and the benchmark
gives the latent axes. Every window of every document is projected and
compared with the benchmark items by cosine; candidates are decided by the longest common
subsequence of words in a tight stretch of the document, and, where that alone is not enough (a
paraphrase), by whether the item's answer, its closing words, is there too.

The benchmark is the stated query set. It is worked through in blocks of a bounded number of items,
so what is broadcast stays bounded whatever its size; documents are never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, prepare, tidy
from .textkeys import word_hashes

WINDOW = 64
STRIDE = 32
RANK = 96
OVERSAMPLE = 16
POWER = 1
#: All passages of the corpus weigh together as many as there are items, at least this. More would
#: turn the axes to the corpus' common words and away from what tells items apart.
LEAST_WEIGHT = 256
#: Values of a matrix of passages that are multiplied at once.
VALUES = 8_192
ITEMS_PER_BLOCK = 5_000
#: A candidate's cosine in the latent space.
COSINE = 0.4
#: Common subsequence as a share of the item: enough alone; enough with the answer; share of the answer.
COPY = 0.8
PARAPHRASE = 0.6
ANSWER = 0.8
#: The item's closing share of words that stands for its answer, and how far a stretch may be drawn out.
ANSWER_PART = 0.25
LOOSE = 1.25


def _words(texts) -> list[np.ndarray]:
    out = []
    for _, hashes, at in word_hashes(pa.array(texts, pa.large_string())):
        out += [hashes[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def _place(hashes: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Each word's term, or -1."""
    if not len(terms):
        return np.full(len(hashes), -1)
    at = np.searchsorted(terms, hashes)
    at[at == len(terms)] = 0
    return np.where(terms[at] == hashes, at, -1)


# --- fitting ---------------------------------------------------------------------------------


def _passages(terms, window: int):
    """Each text's terms, packed, in passages that don't overlap, and the passages' numbers of terms."""

    def run(batches):
        for batch in batches:
            for _, hashes, at in word_hashes(batch.column("text")):
                term = _place(hashes, terms.value).astype(np.int32)
                lens = np.diff(at)
                many = -(-lens // window)
                first = np.concatenate([[0], np.cumsum(many)])
                within = np.arange(len(term)) - np.repeat(at[:-1] - at[0], lens)
                on = term >= 0
                size = np.bincount((np.repeat(first[:-1], lens) + within // window)[on], minlength=first[-1]).astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(on)])[at - at[0]]
                used = term[on]
                rows = [used[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
                sizes = [size[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(sizes, pa.binary())], names=["terms", "sizes"])

    return tidy(run)


def _unpack(column) -> list[np.ndarray]:
    return [np.frombuffer(v, np.int32) for v in column.to_pylist()]


def _frequencies(many: int):
    """In how many texts each term is, and as term -1 the number of texts and as -2 that of passages with a term."""

    def run(batches):
        df, n, passages = np.zeros(many, np.int64), 0, 0
        for batch in batches:
            rows = _unpack(batch.column("terms"))
            doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            seen = np.unique(doc * many + np.concatenate(rows)) % many if many and len(doc) else np.zeros(0, np.int64)
            df += np.bincount(seen, minlength=many)
            n += len(rows)
            passages += sum(np.count_nonzero(z) for z in _unpack(batch.column("sizes")))
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *used.tolist()], pa.int64()), pa.array([n, passages, *df[used].tolist()], pa.int64())], names=["term", "n"])

    return tidy(run)


def _sparse(terms: np.ndarray, sizes: np.ndarray, idf):
    """Unit TF-IDF rows of passages as (row, term, value) triples in the order of row and term."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    key, tf = np.unique(row * len(idf) + terms, return_counts=True)
    row, term = key // len(idf), key % len(idf)
    value = tf * idf[term]
    norm = np.sqrt(np.bincount(row, value * value, len(sizes)))
    return row, term, (value / np.maximum(norm[row], 1e-12)).astype(np.float32)


def _sums(values: np.ndarray, of: np.ndarray):
    """The different entries of sorted `of` and the sums of their rows."""
    start = np.flatnonzero(np.diff(of, prepend=-1))
    return of[start], np.add.reduceat(values, start)


def _gram(idf, basis):
    """Sum over passages of a (a . basis): the columns A'A basis, as one row per term."""

    def run(batches):
        q = basis.value.astype(np.float32)
        z = np.zeros(basis.value.shape)
        for batch in batches:
            terms, sizes = (np.concatenate([*_unpack(batch.column(c)), np.zeros(0, np.int32)]) for c in ("terms", "sizes"))
            if not len(terms):
                continue
            row, term, value = _sparse(terms, sizes[sizes > 0], idf.value)
            cuts = np.concatenate([np.flatnonzero(np.diff(row, prepend=-1)), [len(row)]])
            a = 0
            while a < len(row):  # whole passages, VALUES of them or one
                b = int(cuts[max(np.searchsorted(cuts, a + VALUES, "right") - 1, np.searchsorted(cuts, a, "right"))])
                part = q[term[a:b]]
                part *= value[a:b, None]
                _, y = _sums(part, row[a:b])
                order = np.argsort(term[a:b], kind="stable")
                part = y[row[a:b][order] - row[a]]  # no passage is without a term
                part *= value[a:b][order, None]
                at, sums = _sums(part, term[a:b][order])
                z[at] += sums
                a = b
        used = np.flatnonzero(np.abs(z).sum(1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(z[used]), pa.list_(pa.float64()))], names=["term", "z"])

    return tidy(run)


def _times_gram(passages: DataFrame, idf, basis: np.ndarray) -> np.ndarray:
    sc = passages.sparkSession.sparkContext
    parts = passages.mapInArrow(_gram(sc.broadcast(idf), sc.broadcast(basis)), "term long, z array<double>")
    columns = [F.sum(F.col("z")[i]).alias(f"z{i}") for i in range(basis.shape[1])]
    rows = parts.groupBy("term").agg(*columns).toPandas()  # at most a row per benchmark term
    out = np.zeros_like(basis)
    if len(rows):
        out[rows["term"].to_numpy()] = rows.drop(columns="term").to_numpy()
    return out


def randomised_svd(corpus: DataFrame, weight: float, own: DataFrame, idf: np.ndarray, rank: int, power: int = POWER, seed: int = 7) -> np.ndarray:
    """The leading right singular vectors (terms x rank) of the TF-IDF matrix of weighted passages.

    The rows of A are the benchmark's own passages and, each times the root of weight, all of the
    corpus. A random basis is multiplied by the benchmark's part of A'A and made orthonormal; then
    one pass over all passages gives Z = A'A Q, and Z (Q'Z)^-1 Z' stands for A'A (Nystroem).
    """
    k = min(len(idf), rank + OVERSAMPLE)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(idf), k)))[0]
    for _ in range(1 + power):
        q = np.linalg.qr(_times_gram(own, idf, q) + 1e-9 * q)[0]
    z = _times_gram(own, idf, q) + weight * _times_gram(corpus, idf, q)
    value, u = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
    on = value > 1e-6 * max(float(value.max()), 1e-12)
    return np.ascontiguousarray(np.linalg.svd(z @ u[:, on] / np.sqrt(value[on]), full_matrices=False)[0][:, :rank])


def fit(docs: DataFrame, items: list[np.ndarray], rank: int = RANK, window: int = WINDOW) -> dict:
    """Terms, idf and latent term vectors for the words of items, from all passages of all documents."""
    spark = docs.sparkSession
    terms = np.unique(np.concatenate([*items, np.zeros(0, np.uint64)]))
    if not len(terms):
        return {"terms": terms, "idf": np.zeros(0), "vectors": np.zeros((0, 1), np.float32)}
    corpus = materialise(docs.select("text").mapInArrow(_passages(spark.sparkContext.broadcast(terms), window), "terms binary, sizes binary"), "passages")
    counts = dict(tuple(r) for r in corpus.mapInArrow(_frequencies(len(terms)), "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    n, many = counts.pop(-1, 0) or 0, counts.pop(-2, 0) or 0
    idf = np.log((1 + n) / (1 + np.array([counts.get(i, 0) for i in range(len(terms))], float))) + 0.05
    packed = [(bytearray(_place(w, terms).astype(np.int32).tobytes()), bytearray(np.array([len(w)], np.int32).tobytes())) for w in items if len(w)]
    own = spark.createDataFrame(packed, "terms binary, sizes binary")
    weight = min(1.0, max(LEAST_WEIGHT, len(items)) / max(1, many))
    axes = randomised_svd(corpus, weight, own, idf, min(rank, len(terms)))
    return {"terms": terms, "idf": idf, "vectors": (idf[:, None] * axes).astype(np.float32)}


# --- retrieval -------------------------------------------------------------------------------


def lcs_bits(item: dict[int, int], length: int, words: list[int]) -> int:
    """Bit-parallel longest common subsequence: a row of ones with a zero for each match in it."""
    full = (1 << length) - 1
    v = full
    for w in words:
        m = item.get(w, 0)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return v


class Item:
    __slots__ = ("item_id", "words", "masks", "answer", "answer_masks")

    def __init__(self, item_id, words: np.ndarray):
        self.item_id, self.words = item_id, words.tolist()
        self.masks = self._masks(self.words)
        self.answer = self.words[-max(1, round(ANSWER_PART * len(self.words))) :]
        self.answer_masks = self._masks(self.answer)

    @staticmethod
    def _masks(words: list[int]) -> dict[int, int]:
        out: dict[int, int] = {}
        for i, w in enumerate(words):
            out[w] = out.get(w, 0) | 1 << i
        return out

    def share(self, words: list[int]) -> float:
        n = len(self.words)
        return (n - lcs_bits(self.masks, n, words).bit_count()) / n

    def answered(self, words: list[int]) -> float:
        n = len(self.answer)
        return (n - lcs_bits(self.answer_masks, n, words).bit_count()) / n

    def best(self, words: list[int]) -> tuple[float, float]:
        """Best share of the item, and of its answer, in a stretch of words little longer than it.

        A stretch that leaks goes before all that don't, whatever their shares.
        """
        if self.share(words) < PARAPHRASE:
            return 0.0, 0.0
        span = int(LOOSE * len(self.words)) + 2
        best = (0.0, 0.0)
        for s in range(0, max(1, len(words) - span + 1)):
            part = words[s : s + span]
            share = self.share(part)
            if share < PARAPHRASE:
                continue
            best = max(best, (share, self.answered(part)), key=lambda b: (leaks(*b), b))
            if share == 1:
                break
        return best


def leaks(share: float, answer: float) -> bool:
    return share >= COPY or (share >= PARAPHRASE and answer >= ANSWER)


class Places:
    """For each item the places of its terms as bits (of items under 64 words), and how many must be met at least.

    One row of bits over all terms is kept, and filled for one item at a time: memory grows with the
    terms and with the items' words, not with their product.
    """

    def __init__(self, items, terms: np.ndarray):
        self.row = np.zeros(len(terms) + 1, np.uint64)  # the last one stands for other words
        self.need = np.zeros(len(items), np.int64)
        self.terms, self.bits = [], []
        for q, (_, words) in enumerate(items):
            short = len(words) < 64
            own = _place(words, terms) if short else np.zeros(0, np.int64)
            self.need[q] = int(np.ceil(PARAPHRASE * len(words) - 1e-9)) if short else 0
            self.terms.append(own.astype(np.int32))
            self.bits.append(np.uint64(1) << np.arange(len(own), dtype=np.uint64))

    def may_match(self, term, start, low, high, item, window: int, stride: int, step: int = 4096) -> np.ndarray:
        """Exact bound on the common subsequence: the places of the item whose word stands in the window
        or a stride beside it. Any tight stretch of an item under 64 words lies in one such window."""
        out = np.zeros(len(start), bool)
        reach = np.arange(-stride, window + stride)
        order = np.argsort(item, kind="stable")
        cuts = np.flatnonzero(np.diff(item[order], prepend=-1, append=-1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            q = int(item[order[a]])
            np.bitwise_or.at(self.row, self.terms[q], self.bits[q])  # a term may have several places
            for i in range(a, b, step):
                mine = order[i : min(i + step, b)]
                at = start[mine, None] + reach
                inside = (at >= low[mine, None]) & (at < high[mine, None])
                t = np.where(inside, term[np.clip(at, 0, len(term) - 1)], -1)
                out[mine] = np.bitwise_count(np.bitwise_or.reduce(self.row[t], axis=1)) >= self.need[q]
            self.row[self.terms[q]] = 0
        return out


def _search(model, items, window: int, stride: int, cosine: float):
    def run(batches):
        m, own = model.value, [Item(i, w) for i, w in items.value]
        vectors = np.concatenate([m["vectors"], np.zeros((1, m["vectors"].shape[1]), np.float32)])  # the last stands for other words
        queries = np.stack([vectors[_place(w, m["terms"])].sum(0) for _, w in items.value])
        queries /= np.maximum(np.sqrt((queries * queries).sum(1, keepdims=True)), 1e-12)
        places = Places(items.value, m["terms"])
        per = window // stride
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out = []
            for row, hashes, at in word_hashes(batch.column("text")):
                term = _place(hashes, m["terms"])
                lens = np.diff(at)
                many = -(-lens // stride)  # blocks of stride words; a window is `per` of them
                first_block = np.concatenate([[0], np.cumsum(many)])
                total = int(first_block[-1])
                if not total:
                    continue
                doc = np.repeat(np.arange(len(lens)), many)
                start = at[:-1][doc] + (np.arange(total) - first_block[doc]) * stride
                sums = np.zeros((total, vectors.shape[1]), np.float32)
                used = term[term >= 0]  # other words add nothing
                first = np.concatenate([[0], np.cumsum(term >= 0)])[np.concatenate([start, [len(term)]])]
                filled = np.flatnonzero(np.diff(first))
                for i in range(0, len(filled), 2048):
                    part = filled[i : i + 2048]
                    base, end = first[part[0]], first[part[-1] + 1]
                    sums[part] = np.add.reduceat(vectors[used[base:end]], first[part] - base)
                win = sums.copy()
                for k in range(1, per):
                    same = doc[k:] == doc[:-k]
                    win[:-k][same] += sums[k:][same]
                norm = np.maximum(np.sqrt((win * win).sum(1)), 1e-9)
                for i in range(0, total, 4096):
                    score = win[i : i + 4096] @ queries.T
                    w, q = np.nonzero(score >= cosine * norm[i : i + 4096, None])
                    keep = places.may_match(term, start[i + w], at[doc[i + w]], at[doc[i + w] + 1], q, window, stride)
                    best: dict = {}
                    for w, q in zip(w[keep].tolist(), q[keep].tolist(), strict=True):
                        d = int(doc[i + w])
                        if best.get((d, q), (0.0,))[0] == 1.0:
                            continue
                        reach = stride if len(own[q].words) < 64 else len(own[q].words)
                        s, e = max(int(at[d]), int(start[i + w]) - reach), min(int(at[d + 1]), int(start[i + w]) + window + reach)
                        got = (*own[q].best(hashes[s:e].tolist()), float(score[w, q] / norm[i + w]))
                        if leaks(*got[:2]):
                            best[d, q] = max(got, best.get((d, q), (0.0,)))
                    out += [(ids[row + d], own[q].item_id, close, share, answer) for (d, q), (share, answer, close) in best.items()]
            for i in range(0, len(out), 1000):
                columns = list(zip(*out[i : i + 1000], strict=True))
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "cosine", "lcs", "answer"])

    return tidy(run)


def find_leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, cosine: float = COSINE, window: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """Rows (doc_id, item_id, cosine, lcs, answer) for each document that holds a benchmark item.

    Every window of every whole text is compared. Null and empty texts and items match nothing;
    a null id is returned as null; rows of one id give one row for each item (the best); items of
    equal text each match; an empty benchmark or corpus gives an empty result; other columns aren't
    read. Items longer than a window are found by their windows and checked on all their words.
    """
    spark = prepare(docs.sparkSession)
    found = None
    rows = benchmark.select("item_id", "text").where("text is not null")
    for block in _blocks(rows):
        items = [(i, w) for (i, _), w in zip(block, _words([t for _, t in block]), strict=True) if len(w)]
        if not items:
            continue
        model = fit(docs, [w for _, w in items], rank, window)
        search = _search(spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(items), window, stride, cosine)
        part = docs.select("doc_id", "text").mapInArrow(search, "doc_id long, item_id long, cosine double, lcs double, answer double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, cosine double, lcs double, answer double")
    best = F.max(F.struct("lcs", "answer", "cosine")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.cosine", "b.lcs", "b.answer")


def _blocks(items: DataFrame):
    """The query set in blocks of at most ITEMS_PER_BLOCK rows on the driver."""
    block = []
    for r in items.toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == ITEMS_PER_BLOCK:
            yield block
            block = []
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) without the rows that hold a benchmark item; all columns stay.

    Each row is judged by its own text, also where ids are null or repeat; equal rows share their
    fate. Null and empty texts stay; very long ones are read whole; an empty table stays empty and
    an empty benchmark drops nothing; further columns, whatever their names, are carried along.
    """
    row = F.xxhash64("doc_id", "text")
    leaks_ = find_leaks(docs.select(row.alias("doc_id"), "text"), benchmark)
    bad = materialise(leaks_.select(F.col("doc_id").alias("__leak")).distinct(), "leaks")
    return docs.join(bad, row == F.col("__leak"), "left_anti")
