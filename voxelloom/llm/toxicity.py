"""Toxic spans and document scores by a linear-chain conditional random field.

Training: of the labelled rows a bounded sample is taken. A word is a labelled toxic token where it
stands in a toxic document and its type occurs in toxic documents far more often than in clean
ones, counted over different contexts so that copies of one document count once. A two-label chain
is fitted to these tokens (emissions from hashed word, prefix and suffix features; transitions) by
gradient steps on its exact likelihood. A logistic curve then maps a document's aggregated
marginals to a score, fitted on the documents' own labels.

Scoring: forward-backward marginals of every word of every whole text, in numpy per Arrow slice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clean_worker, materialise, prepare, tidy
from .textkeys import _WORD, mix64, shingles, word_hashes
from .token_output import span_hashes, text_slices

#: Bounds of the training sample: rows of each label, and characters of a row that may be in it.
SAMPLE_TOXIC = 2000
SAMPLE_CLEAN = 4000
SAMPLE_CHARS = 20_000
DIMENSIONS = 1 << 18
PREFIXES = (3, 4, 5, 6)
SUFFIXES = (3,)
EPOCHS = 8
LEAST_STEPS = 200
SEGMENT = 64
LEAST_CONTEXTS = 3
MOST_CLEAN = 0.02
SPAN_FROM = 0.5
TOXIC_FROM = 0.7
FLOOR = 1e-4


# --- features --------------------------------------------------------------------------------


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters in UTF-8 bytes; lengths stay."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        second = np.zeros(len(data), bool)
        second[1:] = data[:-1] == 0xC3
        out[second & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
    return out


def words_of(data: np.ndarray, bounds: np.ndarray):
    """Word spans of texts that lie side by side, and each text's bounds in them."""
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = _WORD[data]
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[::2], edge[1::2]
    inner = bounds[1:-1]
    if len(inner) and len(starts):
        at = np.searchsorted(starts, inner, "right") - 1
        cut = np.unique(inner[(at >= 0) & (starts[at] < inner) & (ends[at] > inner)])
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, bounds)


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Each word's type, and each type's hash and feature columns."""
    folded = fold(data)
    whole = mix64(span_hashes(folded, starts, ends)[0])
    types, first, inverse = np.unique(whole, return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    columns = [types]
    for n in PREFIXES:
        columns.append(mix64(span_hashes(folded, s, np.minimum(e, s + n))[0] + np.uint64(1000 + n)))
    for n in SUFFIXES:
        columns.append(mix64(span_hashes(folded, np.maximum(s, e - n), e)[0] + np.uint64(2000 + n)))
    return inverse, types, np.stack([(c % np.uint64(DIMENSIONS)).astype(np.int64) for c in columns], 1)


# --- the chain -------------------------------------------------------------------------------


def marginals(score: np.ndarray, bounds: np.ndarray, trans) -> np.ndarray:
    """P(toxic) of each word of sequences side by side, by forward-backward.

    With two labels each message is one ratio toxic / clean. All sequences go in step, longest
    first, so that those which have ended fall off the end of the vectors.
    """
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    order = order[: np.count_nonzero(n)]
    if not len(order):
        return np.zeros(0)
    start, length = bounds[:-1][order], n[order]
    steps = int(length[0])
    active = np.searchsorted(-length, -np.arange(steps), "left")  # sequences longer than t
    oo, ot, to, tt = np.exp(trans)
    e = np.exp(np.clip(score, -30, 30))
    fwd = np.empty(len(score))
    f = e[start]
    fwd[start] = f
    for t in range(1, steps):
        k = active[t]
        at = start[:k] + t
        f = f[:k]
        f = np.clip(e[at] * (ot + tt * f) / (oo + to * f), 1e-30, 1e30)
        fwd[at] = f
    bwd = np.ones(len(score))
    b = np.ones(len(order))
    for t in range(steps - 2, -1, -1):
        k = active[t + 1]
        at = start[:k] + t
        eb = e[at + 1] * b[:k]
        now = np.clip((to + tt * eb) / (oo + ot * eb), 1e-30, 1e30)
        b[:k] = now
        bwd[at] = now
    q = fwd * bwd
    return q / (1 + q)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> dict:
    """Chain and curve from labelled whole texts; of one label only: scores are that label's share."""
    first = _unlike(texts)
    texts, y_doc = [texts[i] for i in first], np.asarray(labels, np.int64)[first]
    model = {"weights": np.zeros(DIMENSIONS), "trans": np.zeros(4), "bias": -8.0, "curve": (0.0, 0.0)}
    if not len(y_doc) or y_doc.min() == y_doc.max():
        share = float(y_doc.mean()) if len(y_doc) else 0.0
        return model | {"constant": share}
    slices = list(text_slices(pa.array(texts, pa.large_string()), 1 << 40))
    _, data, bounds = slices[0]
    starts, ends, at = words_of(data, bounds)
    inverse, types, cols = features(data, starts, ends)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    toxic_word = y_doc[doc] == 1
    # Contexts of each type: the word with both its neighbours.
    pad = np.concatenate([[0], types[inverse], [0]]).astype(np.uint64)
    context = mix64(mix64(pad[:-2] + np.uint64(3)) + mix64(pad[1:-1]) * np.uint64(5) + pad[2:])
    # A context holds its word, so the first of each stands for it.
    firsts = [np.flatnonzero(chosen)[np.unique(context[chosen], return_index=True)[1]] for chosen in (toxic_word, ~toxic_word)]
    share = toxic_word.mean()
    seed = np.zeros(len(types), bool)
    for level in range(1 + len(PREFIXES)):  # whole words, then prefixes
        column = inverse if level == 0 else np.unique(cols[:, level], return_inverse=True)[1][inverse]
        a, b = (np.bincount(column[f], minlength=int(column.max()) + 1).astype(float) for f in firsts)
        n = np.maximum(a + b, 1)
        gain = a * np.log(np.maximum(a, 1) / (n * share)) + b * np.log(np.maximum(b, 1) / (n * (1 - share)))
        # As many groups are tested as there are: the gain must beat their number.
        good = (a >= LEAST_CONTEXTS) & (b <= MOST_CLEAN * a) & (gain >= np.log(len(n)) + 2)
        seed[inverse[good[column]]] = True
    y = (seed[inverse] & toxic_word).astype(float)

    # Sequences of at most SEGMENT words, in a fixed random order of mini-batches.
    pieces = np.concatenate([np.arange(a, b, SEGMENT) for a, b in zip(at[:-1], at[1:], strict=True)] + [[at[-1]]]).astype(np.int64)
    lens = np.diff(pieces)
    rng = np.random.default_rng(7)
    w, trans, bias = model["weights"], model["trans"], model["bias"]
    gw, gt, gb = np.full(DIMENSIONS, 1e-6), np.full(4, 1e-6), 1e-6
    per = 2048
    epochs = max(epochs, -(-LEAST_STEPS * per // max(1, len(lens))))
    for epoch in range(epochs):
        rate = 0.5 / np.sqrt(1 + epoch)
        perm = rng.permutation(len(lens))
        for i in range(0, len(perm), per):
            mine = perm[i : i + per]
            mine = mine[lens[mine] > 0]
            if not len(mine):
                continue
            n = lens[mine]
            b = np.concatenate([[0], np.cumsum(n)])
            idx = np.arange(b[-1]) + np.repeat(pieces[mine] - b[:-1], n)
            f = cols[inverse[idx]]
            p = marginals(w[f].sum(1) + bias, b, trans)
            g = p - y[idx]
            grad = np.bincount(f.ravel(), np.repeat(g, f.shape[1]), DIMENSIONS) + 1e-3 * w
            gw += grad * grad
            w -= rate * grad / np.sqrt(gw)
            db = g.sum()
            gb += db * db
            bias -= rate * db / np.sqrt(gb)
            # Pairs of neighbours: expected by the product of marginals and the transition's own
            # potential would need pair marginals; the gradient on them is taken exactly.
            dt = _pair_gradient(w[f].sum(1) + bias, b, trans, y[idx])
            gt += dt * dt
            trans -= 0.1 * rate * dt / np.sqrt(gt)
    model |= {"weights": w, "trans": trans, "bias": float(bias)}
    p = marginals(w[cols].sum(1)[inverse] + bias, at, trans)
    x = np.log(FLOOR + np.bincount(doc, p * p, len(texts)))
    model["curve"] = _logistic(x, y_doc)
    return model


def _unlike(texts: list[str], coords: int = 4) -> np.ndarray:
    """The first of each group of near copies: texts that share a minimum hash of five-word shingles.

    Copies with small edits would otherwise lend their rare words several contexts.
    """
    keep, seen = [], set()
    for row, hashes, bounds in word_hashes(pa.array(texts, pa.large_string())):
        sh, at = shingles(hashes, bounds, 5)
        for i in range(len(at) - 1):
            own = sh[at[i] : at[i + 1]]
            marks = {(c, int(mix64(own + np.uint64(c * 7919 + 1)).min())) for c in range(coords)} if len(own) else {(-1, row + i)}
            if not marks & seen:
                keep.append(row + i)
            seen |= marks
    return np.array(keep, np.int64)


def _pair_gradient(score, bounds, trans, y) -> np.ndarray:
    """Expected less observed counts of the four transitions, from node marginals under the chain."""
    oo, ot, to, tt = np.exp(trans)
    p = np.clip(marginals(score, bounds, trans), 1e-12, 1 - 1e-12)
    inside = np.ones(len(score), bool)
    inside[bounds[1:-1]] = False
    inside[0] = False
    b = np.flatnonzero(inside)
    a = b - 1
    # The pair table with these margins and the odds ratio of the transitions (2 x 2, closed form).
    ratio = oo * tt / (ot * to)
    s = p[a] + p[b]
    if abs(ratio - 1) < 1e-9:
        both = p[a] * p[b]
    else:
        q = 1 + s * (ratio - 1)
        both = (q - np.sqrt(np.maximum(0, q * q - 4 * ratio * (ratio - 1) * p[a] * p[b]))) / (2 * (ratio - 1))
    expected = np.array([(1 - s + both).sum(), (p[b] - both).sum(), (p[a] - both).sum(), both.sum()])
    seen = np.array([((1 - y[a]) * (1 - y[b])).sum(), ((1 - y[a]) * y[b]).sum(), (y[a] * (1 - y[b])).sum(), (y[a] * y[b]).sum()])
    return expected - seen


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2):
    """(intercept, slope) of a logistic curve by damped Newton steps."""
    m = np.stack([np.ones_like(x), x], 1)
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(m @ beta, -30, 30)))
        h = (m * (p * (1 - p))[:, None]).T @ m + ridge * np.eye(2)
        step = np.linalg.solve(h, m.T @ (p - y) + ridge * beta)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(beta)


def fit(docs: DataFrame, labels: DataFrame, seed: int = 7) -> dict:
    """Train on a bounded sample of labelled rows: hash order, each label's bound, each row's length.

    Rows whose label or text is null are left out; of repeated texts one is taken.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sized = docs.where("text is not null").select("doc_id", F.char_length("text").alias("n")).where(F.col("n") <= SAMPLE_CHARS)
    ids = sized.join(known, "doc_id").select("doc_id", "toxic").distinct()  # texts stay where they are
    order = (F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id"))
    parts = [ids.where(F.col("toxic") == v).orderBy(*order).limit(n) for v, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    # At most SAMPLE_TOXIC + SAMPLE_CLEAN rows: small enough to go to every task.
    chosen = F.broadcast(materialise(parts[0].unionByName(parts[1]), "training-ids"))
    rows = docs.select("doc_id", "text").where(F.char_length("text") <= SAMPLE_CHARS).join(chosen, "doc_id")
    rows = rows.select("doc_id", "text", "toxic").toPandas().sort_values(["doc_id", "text"]).drop_duplicates("text")
    texts, toxic = rows["text"].tolist(), rows["toxic"].tolist()
    del rows
    model = train(texts, toxic)
    del texts
    clean_worker()  # the driver lives on too
    return model


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """All columns of docs(text, ...) with toxic_score, toxic_words and toxic_spans.

    Spans are code-point offsets of runs of words whose marginal is SPAN_FROM or more. Null and
    empty texts have no words: no spans, and the score of no evidence. The new columns replace
    columns of their names in any case; very long texts are read whole, repeated rows score alike;
    an empty table stays empty.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # DIMENSIONS weights, whatever the corpus
    names = ("toxic_score", "toxic_words", "toxic_spans")
    kept = [c for c in docs.columns if c.lower() not in names]
    fields = [docs.schema[c] for c in kept]
    schema = T.StructType([*fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.LongType()), T.StructField(names[2], SPANS)])
    where = kept.index("text")

    def run(batches):
        m = shared.value
        for batch in batches:
            for row, data, bounds in text_slices(batch.column(where)):
                s, words, spans = _score_slice(m, data, bounds)
                part = batch.slice(row, len(bounds) - 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array(words), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=schema.names)

    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(tidy(run), schema)


def _score_slice(m: dict, data: np.ndarray, bounds: np.ndarray):
    n = len(bounds) - 1
    spans: list[list] = [[] for _ in range(n)]
    if "constant" in m:
        return np.full(n, m["constant"]), np.zeros(n, np.int64), spans
    starts, ends, at = words_of(data, bounds)
    doc = np.repeat(np.arange(n), np.diff(at))
    evidence = np.zeros(n)
    hits = np.zeros(n, np.int64)
    if len(starts):
        inverse, _, cols = features(data, starts, ends)
        p = marginals(m["weights"][cols].sum(1)[inverse] + m["bias"], at, m["trans"])
        evidence = np.bincount(doc, p * p, n)
        on = np.flatnonzero(p >= SPAN_FROM)
        hits = np.bincount(doc[on], minlength=n)
        if len(on):
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            last = None
            for i in on.tolist():
                d = int(doc[i])
                s, e = int(points[starts[i]] - points[bounds[d]]), int(points[ends[i]] - points[bounds[d]])
                if last == (d, i - 1):
                    spans[d][-1]["end"] = e
                else:
                    spans[d].append({"start": s, "end": e})
                last = (d, i)
    a, b = m["curve"]
    return 1 / (1 + np.exp(-np.clip(a + b * np.log(FLOOR + evidence), -30, 30))), hits, spans


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id's text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = TOXIC_FROM) -> DataFrame:
    """docs(doc_id, text, ...) without the documents that score threshold or more.

    All of docs' own columns stay as they are, whatever their names. Null and empty texts and null
    ids are judged like all others, repeated rows alike; an empty table stays empty; without labels
    nothing goes.
    """
    model = fit(docs, labels.where(~held_out()))
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    return score(rows, model).where(F.col("toxic_score") < threshold).select(*[F.col(f"__row.`{c}`") for c in docs.columns])
