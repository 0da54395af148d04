"""Quality rules: lines labelled content or boilerplate by a linear-chain conditional random field.

A line's features are shares and counts of its characters and words, put into bins. The chain of a
text's lines is decoded by Viterbi; the share of its words in content lines decides whether a
document stays, after a few counted rules.

Only documents are labelled, so the lines' labels are learnt in turns on a bounded sample: all lines
of low-quality documents start as boilerplate; a chain is fitted by gradient steps on its
likelihood; lines of low-quality documents that it takes for content become content; and so on
ROUNDS times. Lines of good documents stay content. Everything else covers all rows and whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, prepare, tidy
from .textkeys import mix64
from .token_output import span_hashes, text_slices
from .toxicity import _pair_gradient, _unlike, marginals

#: Bounds of the training sample: documents of low and of good quality, and characters of each.
SAMPLE_LOW = 2000
SAMPLE_GOOD = 4000
SAMPLE_CHARS = 20_000
ROUNDS = 3
EPOCHS = 12
LEAST_STEPS = 150
PER_STEP = 256
KEEP_FROM = 0.5
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # words of a hundred

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _bytes_of(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


SYMBOL = _bytes_of("#*$%&|<>")
STOP, CALL, DIGIT, UPPER = _bytes_of(".,;:"), _bytes_of("!?"), _bytes_of("0123456789"), _bytes_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Classes of a first or last character.
CLASS = np.zeros(256, np.int64)
for _i, _of in enumerate((STOP, CALL, SYMBOL, DIGIT, UPPER, _bytes_of("-_=~+"), _bytes_of("\"'()[]{}")), 1):
    CLASS[_of] = _i
SHARES = np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97, 0.999])
BINS = 16


class Layout:
    """Words and lines of texts that lie side by side; lines are those with a word."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds
        word = np.zeros(len(data) + 2, bool)
        word[1:-1] = ~_SPACE[data]
        edge = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edge[::2], edge[1::2]
        inner = np.unique(bounds[1:-1])
        if len(inner) and len(starts):  # a word ends with its text
            at = np.searchsorted(starts, inner, "right") - 1
            cut = inner[(at >= 0) & (starts[at] < inner) & (ends[at] > inner)]
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        self.starts, self.ends = starts, ends
        self.of_text = np.searchsorted(starts, bounds)  # each text's bounds in the words
        self.hashes = mix64(span_hashes(data, starts, ends)[0]) if len(starts) else np.zeros(0, np.uint64)
        breaks = np.flatnonzero(data == 10)
        begin, end = np.sort(np.concatenate([bounds[:-1], breaks + 1])), np.sort(np.concatenate([breaks, bounds[1:]]))
        first, last = np.searchsorted(starts, begin), np.searchsorted(starts, end)
        held = last > first
        self.line_start, self.line_end, self.first, self.last = begin[held], end[held], first[held], last[held]
        self.line_text = np.searchsorted(bounds, self.line_start, "right") - 1
        self.of_lines = np.searchsorted(self.line_text, np.arange(len(bounds)))

    def per_text(self, marks: np.ndarray, by: str = "bytes") -> np.ndarray:
        """Sums of marks over each text's bytes, words or lines."""
        at = {"bytes": self.bounds, "words": self.of_text, "lines": self.of_lines}[by]
        full = np.flatnonzero(np.diff(at))
        out = np.zeros(len(at) - 1, np.int64)
        if len(full):
            out[full] = np.add.reduceat(marks, at[full], dtype=np.int64)
        return out

    def per_line(self, marks: np.ndarray) -> np.ndarray:
        """Sums of marks over each line's bytes (only white space lies between lines)."""
        return np.add.reduceat(marks, self.line_start, dtype=np.int64) if len(self.line_start) else np.zeros(0, np.int64)

    def per_line_words(self, marks: np.ndarray) -> np.ndarray:
        return np.add.reduceat(marks, self.first, dtype=np.int64) if len(self.first) else np.zeros(0, np.int64)

    def repeated_lines(self) -> np.ndarray:
        """Lines that equal an earlier line of their text."""
        one, two = span_hashes(self.data, self.line_start, self.line_end) if len(self.line_start) else (np.zeros(0, np.uint64),) * 2
        order = np.lexsort((two, one, self.line_text))
        t, a, b = self.line_text[order], one[order], two[order]
        out = np.zeros(len(order), bool)
        out[order[1:]] = (t[1:] == t[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        return out  # the sort is stable, so the first of equal lines is the earliest

    def repeated_words(self) -> np.ndarray:
        """Words inside windows of WINDOW words that stand twice or more in their text."""
        n = len(self.hashes)
        size = np.diff(self.of_text)
        text = np.repeat(np.arange(len(size)), size)
        start = np.flatnonzero(np.arange(n) + WINDOW <= np.repeat(self.of_text[1:], size))
        key = text[start].astype(np.uint64)
        for k in range(WINDOW):
            key = mix64(key * np.uint64(3) + self.hashes[start + k])
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(start), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, start[twice], 1)
        np.add.at(change, start[twice] + WINDOW, -1)
        return np.cumsum(change[:-1]) > 0


def counts(lay: Layout) -> dict[str, np.ndarray]:
    """The counted rules of each text."""
    points = (lay.data & 0xC0) != 0x80
    return {
        "n_words": np.diff(lay.of_text),
        "word_chars": lay.per_text(points & ~_SPACE[lay.data]),
        "n_symbols": lay.per_text(SYMBOL[lay.data]),
        "n_dup_lines": lay.per_text(lay.repeated_lines(), "lines"),
        "n_repeat_words": lay.per_text(lay.repeated_words(), "words"),
    }


def features(lay: Layout) -> np.ndarray:
    """Each line's feature columns: one bin of each feature."""
    data, n = lay.data, len(lay.first)
    if not n:
        return np.zeros((0, 17), np.int64)
    words = lay.last - lay.first
    line = np.repeat(np.arange(n), words)
    chars = np.maximum(lay.per_line(((data & 0xC0) != 0x80) & ~_SPACE[data]), 1)
    upper = UPPER[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3  # capital letters of Latin-1 in UTF-8
    upper |= after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    first, last = data[lay.starts], data[lay.ends - 1]
    capital = upper[lay.starts] | upper[np.minimum(lay.starts + 1, len(data) - 1)] & (first == 0xC3)
    order = np.lexsort((lay.hashes, line))
    new = np.ones(len(order), np.int64)
    new[1:] = (lay.hashes[order[1:]] != lay.hashes[order[:-1]]) | (line[order[1:]] != line[order[:-1]])
    again = np.zeros(len(line), bool)
    again[1:] = (lay.hashes[1:] == lay.hashes[:-1]) & (line[1:] == line[:-1])
    share = lambda x, of: np.searchsorted(SHARES, x / of, "right")
    place = 2 * (np.arange(n) == lay.of_lines[lay.line_text]) + (np.arange(n) + 1 == lay.of_lines[lay.line_text + 1])
    columns = [
        np.zeros(n, np.int64),
        np.minimum(np.log2(words).astype(np.int64), BINS - 1),
        np.minimum(chars // words, BINS - 1),
        share(lay.per_line(upper), chars),
        share(lay.per_line(SYMBOL[data]), chars),
        share(lay.per_line_words(SYMBOL[first] & (lay.ends - lay.starts == 1)), words),
        share(lay.per_line(DIGIT[data]), chars),
        share(lay.per_line(CALL[data]), chars),
        share(lay.per_line(STOP[data]), chars),
        share(lay.per_line_words(SYMBOL[last]), words),
        share(lay.per_line_words(CALL[last]), words),
        share(lay.per_line_words(capital), words),
        share(np.add.reduceat(new, lay.first), words),
        share(lay.per_line_words(again), words),
        CLASS[first[lay.first]],
        CLASS[last[lay.last - 1]],
        2 * place + lay.repeated_lines(),
    ]
    return np.stack([c + BINS * k for k, c in enumerate(columns)], 1).astype(np.int64)


# --- the chain -------------------------------------------------------------------------------


def viterbi(score: np.ndarray, bounds: np.ndarray, trans) -> np.ndarray:
    """The likeliest labels of sequences side by side: 1 where boilerplate, ties content.

    With two labels each message is one difference, boilerplate less content. All sequences go in
    step, longest first.
    """
    n = np.diff(bounds)
    out = np.zeros(len(score), bool)
    order = np.argsort(-n, kind="stable")
    order = order[: np.count_nonzero(n)]
    if not len(order):
        return out
    start, length = bounds[:-1][order], n[order]
    active = np.searchsorted(-length, -np.arange(int(length[0]) + 1), "left")
    oo, ot, to, tt = trans
    from_bad = np.zeros((2, len(score)), bool)  # by label: its best predecessor is boilerplate
    d = score[start].astype(float)
    ends = np.empty(len(order))
    for t in range(1, int(length[0])):
        k = active[t]
        ends[k : len(d)] = d[k:]
        d = d[:k]
        at = start[:k] + t
        good, bad = d + to > oo, d + tt > ot
        from_bad[0, at], from_bad[1, at] = good, bad
        d = np.where(bad, d + tt, ot) - np.where(good, d + to, oo) + score[at]
    ends[: len(d)] = d
    label = ends > 0
    out[start + length - 1] = label
    for t in range(int(length[0]) - 2, -1, -1):
        k = active[t + 1]
        at = start[:k] + t
        out[at] = np.where(out[at + 1], from_bad[1, at + 1], from_bad[0, at + 1])
    return out


def _fit(cols: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> dict:
    """Weights and transitions by AdaGrad on the chain's likelihood, whole texts in a fixed random order."""
    size = int(cols.shape[1] * BINS)
    w, trans = np.zeros(size), np.zeros(4)
    gw, gt = np.full(size, 1e-6), np.full(4, 1e-6)
    lens = np.diff(bounds)
    texts = np.flatnonzero(lens)
    rng = np.random.default_rng(11)
    epochs = max(EPOCHS, -(-LEAST_STEPS * PER_STEP // max(1, len(texts))))
    for epoch in range(epochs):
        rate = 0.3 / np.sqrt(1 + epoch)
        perm = rng.permutation(texts)
        for i in range(0, len(perm), PER_STEP):
            mine = perm[i : i + PER_STEP]
            b = np.concatenate([[0], np.cumsum(lens[mine])])
            idx = np.arange(b[-1]) + np.repeat(bounds[mine] - b[:-1], lens[mine])
            f = cols[idx]
            score = w[f].sum(1)
            g = marginals(score, b, trans) - y[idx]
            grad = np.bincount(f.ravel(), np.repeat(g, f.shape[1]), size) + 1e-2 * w
            gw += grad * grad
            w -= rate * grad / np.sqrt(gw)
            dt = _pair_gradient(score, b, trans, y[idx]) + 1e-2 * trans
            gt += dt * dt
            trans -= 0.1 * rate * dt / np.sqrt(gt)
    return {"weights": w, "trans": trans}


def train(texts: list[str], low: list[int]) -> dict:
    """A chain from whole texts and whether each is of low quality; of one kind only: all lines are content."""
    first = _unlike(texts)
    texts, bad = [texts[i] for i in first], np.asarray(low, np.int64)[first] == 1
    if not len(bad) or bad.all() or not bad.any():
        return {"constant": 0.0}
    _, data, bounds = next(iter(text_slices(pa.array(texts, pa.large_string()), 1 << 40)))
    lay = Layout(data, bounds)
    cols, doubtful = features(lay), bad[lay.line_text]
    y = doubtful.astype(float)
    for _ in range(ROUNDS):
        model = _fit(cols, lay.of_lines, y)
        y = (doubtful & viterbi(model["weights"][cols].sum(1), lay.of_lines, model["trans"])).astype(float)
        if not y.any():
            break
    return model


def fit(docs: DataFrame, labels: DataFrame, seed: int = 11) -> dict:
    """Train on a bounded sample of labelled rows: hash order, each label's bound, each row's length.

    Rows whose label, id or text is null are left out; of an id's labels the lowest quality counts;
    of repeated texts one is taken.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sized = docs.where("text is not null").select("doc_id", F.char_length("text").alias("n")).where(F.col("n") <= SAMPLE_CHARS)
    ids = sized.join(known, "doc_id").select("doc_id", "quality").distinct()
    order = (F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id"))
    parts = [ids.where(F.col("quality") == v).orderBy(*order).limit(n) for v, n in ((0, SAMPLE_LOW), (1, SAMPLE_GOOD))]
    # At most SAMPLE_LOW + SAMPLE_GOOD rows: small enough to go to every task.
    chosen = F.broadcast(materialise(parts[0].unionByName(parts[1]), "line-training-ids"))
    rows = docs.select("doc_id", "text").where(F.char_length("text") <= SAMPLE_CHARS).join(chosen, "doc_id")
    rows = rows.select("doc_id", "text", "quality").toPandas().sort_values(["doc_id", "text"]).drop_duplicates("text")
    return train(rows["text"].tolist(), (1 - rows["quality"]).tolist())


FIELDS = [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("content_share", T.DoubleType()),
    T.StructField("line_labels", T.StringType()),
    T.StructField("kept", T.BooleanType()),
]


def label_lines(docs: DataFrame, model: dict, keep_from: float = KEEP_FROM) -> DataFrame:
    """All columns of docs(text, ...) with the counts, base_failed, content_share, line_labels and kept.

    line_labels has one letter for each line with a word: C content, B boilerplate. kept is false
    where base_failed, else content_share >= keep_from. Windows and lines are compared by 64 and 128
    bits of hashes. Null texts count as empty: no words, a share of 0, base_failed. The new columns
    replace columns of their names in any case; very long texts are read whole, repeated rows judged
    alike; an empty table stays empty.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # some hundred weights
    names = {f.name for f in FIELDS}
    own = [c for c in docs.columns if c.lower() not in names]
    schema = T.StructType([*[docs.schema[c] for c in own], *FIELDS])
    where = own.index("text")

    def run(batches):
        m = shared.value
        for batch in batches:
            for row, data, bounds in text_slices(batch.column(where)):
                part = batch.slice(row, len(bounds) - 1)
                yield pa.RecordBatch.from_arrays([*part.columns, *_judge(m, data, bounds, keep_from)], names=schema.names)

    return docs.select(*[f"`{c}`" for c in own]).mapInArrow(tidy(run), schema)


def _judge(m: dict, data: np.ndarray, bounds: np.ndarray, keep_from: float) -> list[pa.Array]:
    lay = Layout(data, bounds)
    base = counts(lay)
    n = base["n_words"]
    failed = (n < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * n)
    bad = np.zeros(len(lay.first), bool)
    if "constant" not in m:
        bad = viterbi(m["weights"][features(lay)].sum(1), lay.of_lines, m["trans"])
    content = lay.per_text(np.where(bad, 0, lay.last - lay.first), "lines")
    share = content / np.maximum(n, 1)
    letters = np.where(bad, ord("B"), ord("C")).astype(np.uint8).tobytes().decode()
    labels = [letters[a:b] for a, b in zip(lay.of_lines[:-1].tolist(), lay.of_lines[1:].tolist(), strict=True)]
    return [*[pa.array(c.astype(np.int64)) for c in base.values()], pa.array(failed), pa.array(share), pa.array(labels, pa.string()), pa.array(~failed & (share >= keep_from))]
