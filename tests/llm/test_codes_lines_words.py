"""Vector codes, line quality and spelling variants: brute force, held-out accuracy and odd inputs."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from voxelloom.llm import line_quality, spelling, vector_codes
from voxelloom.llm.token_output import text_slices

from test_llm import SF, empty_documents, odd_documents

# --- vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """Whole distances in Python integers: sorted (vec_id, code, error, label_error), and the digest."""
    good = [(i, [int(np.floor(256 * float(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = max(1, -(-max((len(v) for _, v, _ in good), default=0) // parts)) * parts
    width = size // parts
    good = [(i, v + [0] * (size - len(v)), lab) for i, v, lab in good]
    books = [[v[p * width : (p + 1) * width] for _, v, _ in good[:entries]] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(v[p * width : (p + 1) * width], e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds if good else 0):
        new = [list(b) for b in books]
        for p in range(parts):
            met = {}
            for _, v, _ in good:
                met.setdefault(nearest(v, p)[1], []).append(v[p * width : (p + 1) * width])
            for k, vs in met.items():
                new[p][k] = [sum(c) // len(vs) for c in zip(*vs)]
        books = new
    found = [(i, [nearest(v, p) for p in range(parts)], lab) for i, v, lab in good]
    total = Counter()
    for _, f, lab in found:
        total[lab] += sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), total[lab]) for i, f, lab in found), digest


VECTORS = "vec_id long, embedding array<float>, label int, packed string, n long, label_error long"


def test_codes_of_odd_vectors(spark):
    """Null ids, labels and components, repeated rows, ties, short, empty and large vectors, clashing columns."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.1, 20)], i % 3) for i in range(90)]
    rows += [(3, rows[3][1], None), (3, rows[3][1], None), (None, rows[5][1], 1), (91, None, 1), (92, [0.5, None], 1), (93, [float("nan")] * 20, 1), (94, [float("inf")], 2), (95, [], 2), (96, [0.25, -0.001], None), (97, [300.5] * 20, 2), (-5, [0.0] * 20, 0)]
    out = vector_codes.compress(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS)).collect()
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    want, digest = plain_codes(exact)
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in out) == want
    assert {r.codebooks_sha256 for r in out} == {digest}
    assert vector_codes.compress(spark.createDataFrame([], VECTORS)).count() == 0


def test_labels_without_a_hot_one(spark, monkeypatch):
    """Totals joined by label, not broadcast, are the same."""
    rows = [(i, [float(i % 7), 0.5], i if i % 4 else 0) for i in range(60)]
    data = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS)
    monkeypatch.setattr(vector_codes, "HOT_LABELS", 20)
    out = vector_codes.compress(data).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in out) == plain_codes(rows)[0]


def test_cells_bound_distances_and_filter():
    rng = np.random.default_rng(5)
    entries, queries = rng.integers(-60, 60, (64, 4)), rng.integers(-90, 90, (500, 4))
    entries[10] = entries[3]  # a tie: the lower index wins
    cells = vector_codes.Cells(entries)
    exact = ((queries[:, None, :] - entries[None]) ** 2).sum(2)
    lower, upper = cells.bounds(queries)
    assert (lower <= exact).all() and (exact <= upper).all()
    assert np.count_nonzero(lower <= upper.min(1, keepdims=True)) < 0.4 * exact.size
    index, far = cells.nearest(queries)
    assert (index == exact.argmin(1)).all() and (far == exact.min(1)).all()


def test_errors_beyond_a_long_are_null(spark):
    big = 1e30
    rows = spark.createDataFrame([(0, [-big] * 64, 1, "", 1, 1), (1, [big] * 64, 1, "", 1, 1)], VECTORS)
    coded, books = vector_codes.encode(rows, entries=1, rounds=0)
    out = {r.vec_id: r.error for r in coded.collect()}
    assert out == {0: 0, 1: None} and len(books[0]) == 1


# --- line quality


def plain_counts(text):
    """The counted rules in plain Python."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    n = len(words)
    return [n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n]


def test_counts_equal_plain_ones():
    rng = np.random.default_rng(1)
    pieces = ["a", "bb ", "x\n", "\n", " \t", "é\x0b", "\x0c#", "|", "$1\r\n", "\x1c", " ", "\x85", "日本 ", "w1 w2 w3 w4 w5 w6 w7 w8 "]
    texts = ["", " \n", "a\n", "\na", None] + ["".join(rng.choice(pieces, rng.integers(0, 80))) for _ in range(400)]
    got = []
    for _, data, bounds in text_slices(pa.array(texts, pa.string()), 2000):
        got += zip(*[c.to_pylist() for c in line_quality._judge({"constant": 0.0}, data, bounds, 0.5)])
    assert [list(g[:6]) for g in got] == [plain_counts(t) for t in texts]
    lines = [sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (t or "").split("\n")) for t in texts]
    assert [len(g[7]) for g in got] == lines


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(2)
    trans = np.array([0.4, -0.7, -0.3, 0.9])
    lens = [0, 1, 7, 3, 0, 5]
    bounds = np.concatenate([[0], np.cumsum(lens)])
    score = rng.normal(0, 1, bounds[-1])
    got = line_quality.viterbi(score, bounds, trans)
    for a, b in zip(bounds, bounds[1:]):

        def value(path):
            return sum(s for s, y in zip(score[a:b], path) if y) + sum(trans[2 * p + q] for p, q in zip(path, path[1:]))

        assert tuple(got[a:b]) == max(itertools.product((False, True), repeat=int(b - a)), key=value)


def labelled():
    import duckdb

    at = "/root/testdata/sf0.01"
    return duckdb.sql(f"select doc_id, text, quality from '{at}/documents.parquet' join '{at}/labels.parquet' using (doc_id) order by doc_id").fetchall()


def test_lines_by_held_out_accuracy():
    """Documents that were never learned from: good ones stay unless a counted rule fails, junk goes."""
    rows = [r for r in labelled() if len(r[1]) < 20_000]
    held = [zlib.crc32(str(r[0]).encode()) % 3 == 1 for r in rows]
    model = line_quality.train([r[1] for r, h in zip(rows, held) if not h], [1 - r[2] for r, h in zip(rows, held) if not h])
    rest = [r for r, h in zip(rows, held) if h]
    got = []
    for _, data, bounds in text_slices(pa.array([r[1] for r in rest], pa.string())):
        got += zip(*[c.to_pylist() for c in line_quality._judge(model, data, bounds, 0.5)])
    good = [g for g, r in zip(got, rest) if r[2] == 1]
    low = [g for g, r in zip(got, rest) if r[2] == 0]
    assert np.mean([g[8] for g in good if not g[5]]) >= 0.98
    assert np.mean([g[8] for g in low]) <= 0.1
    # By the chain alone, also where the counted rules would do.
    assert np.mean([g[6] >= 0.5 for g in low if g[0]]) <= 0.35


def test_chain_tells_mixed_lines_apart():
    """Lines of prose between tables of signs: each line is labelled, not the whole text."""
    rows = labelled()
    good, low = ([r[1] for r in rows if r[2] == q and len(r[1]) < 20_000] for q in (1, 0))
    model = line_quality.train(good + low, [0] * len(good) + [1] * len(low))
    prose = [x for t in good for x in t.split("\n") if len(x.split()) > 8][:6]
    junk = "ea | ou | th | re | st | an | er | on | it | in | ti | nd |"
    text = "\n".join([*prose[:3], *[junk] * 3, *prose[3:]])
    _, data, bounds = next(iter(text_slices(pa.array([text]))))
    assert line_quality._judge(model, data, bounds, 0.5)[7].to_pylist() == ["CCCBBBCCC"]


@pytest.mark.parametrize("make", [odd_documents, empty_documents])
def test_lines_of_odd_documents(spark, make):
    docs = make(spark).selectExpr("*", "'x' as Kept", "1 as n_words")
    labels = spark.createDataFrame([(1, 0), (7, 1), (None, 0), (5, None)], "doc_id long, quality int")
    out = line_quality.label_lines(docs, line_quality.fit(docs, labels)).collect()
    assert len(out) == docs.count()
    for r in out:
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed] == plain_counts(r.text)
        assert r.kept is False or not r.base_failed
        assert r.addr == 5 and r.key == "k"


# --- spelling variants


def plain_variants(rows):
    """All pairs of words in plain Python."""
    low = str.maketrans(spelling.UPPER, spelling.LOWER)
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    links = {w: [v for v in words if abs(len(v) - len(w)) < 2 and near(w, v)] for w in words}
    form = {}
    for w, vs in links.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, str(form[w]), root(w), c, len(links[w]), str(form[w] and words[form[w]])) for w, c in words.items())


def rows_of(df):
    return sorted((r.word, str(r.form), r.root, r.n, r.n_near, str(r.form_n)) for r in df.collect())


def made_texts():
    """Chains of forms, ties, accents, deletions, anagrams and letters in one band."""
    rng = np.random.default_rng(9)
    letters = list("abcdeéèüßÀ×÷ÿ")
    words = []
    for base in ("abcde", "abcdeabcde", "éèüßÀ", "aaaaa", "ÿ×÷ab"):
        for k in range(60):
            w = list(base)
            for _ in range(rng.integers(0, 3)):
                i = rng.integers(0, len(w))
                w[i : i + rng.integers(0, 2)] = [str(rng.choice(letters))] * rng.integers(0, 2)
            words.append(("".join(w), int(rng.integers(1, 40))))
    flat = [w for w, c in words for _ in range(c)]
    rng.shuffle(flat)
    return [(i, " ".join(flat[i::23])) for i in range(23)]


@pytest.mark.parametrize("block", [4096, 3])
def test_variants_equal_all_pairs(spark, monkeypatch, block):
    """Also with buckets cut into blocks of three."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    rows = made_texts()
    want = plain_variants(rows)
    assert sum(w[1] != "None" for w in want) > 20 and any(w[1] != "None" and w[2] != w[1] for w in want)
    assert rows_of(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == want


@pytest.mark.parametrize("make", [odd_documents, empty_documents])
def test_variants_of_odd_documents(spark, make):
    docs = make(spark)
    extra = spark.createDataFrame([(None, "wordy Wordy wordz wordz wordz wordz wordz wordz wordy ÀWORDY", "x", "y", 1, 2, 3, "k")] * 2, docs.schema)
    docs = docs.unionByName(extra) if docs.count() else docs
    got = rows_of(spelling.variants(docs))
    assert got == plain_variants([(r.doc_id, r.text) for r in docs.collect()])
    assert bool(got) == bool(docs.count())


def test_variants_of_documents_equal_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows_of(spelling.variants(docs)) == plain_variants([(r.doc_id, r.text) for r in docs.collect()])
