"""Training-data operators: brute force, exact round trips, held-out accuracy and odd inputs."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from voxelloom.llm import decontam, embed_dedup, html_wrapper, jaccard_join, license_scan, mixing, secret_scan, token_output, toxicity, warc
from voxelloom.llm import queries as Q

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, addr long, size long, key string"


def odd_documents(spark):
    """Nulls everywhere, an empty and a long text, repeated rows, and columns named like inner ones."""
    long = " ".join(f"w{i % 700}" for i in range(60_000))
    texts = [(1, "alpha beta gamma delta epsilon zeta"), (2, "alpha beta gamma delta epsilon zeta"), (2, "alpha beta gamma delta epsilon zeta"), (3, ""), (4, None), (None, "one two"), (None, None), (5, long), (6, "  \n "), (7, "one two")]
    return spark.createDataFrame([(i, t, None, None if k % 3 else "s", None, 5, 6, "k") for k, (i, t) in enumerate(texts)], DOCS)


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)


def same(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    show = lambda d: sorted(repr([None if v is None or v != v else float(v) if isinstance(v, (float, np.floating)) else str(v) for v in r]) for r in d[cols].astype(object).itertuples(index=False))
    return show(a) == show(b)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert same(Q.QUERIES[name](spark, SF).toPandas(), con.execute(Q.ORACLE_SQL[name]).df())


# --- token output


def test_coder_round_trip_and_checkpoints():
    rng = np.random.default_rng(0)
    ids = rng.zipf(1.3, 50_000).clip(0, 5000).astype(np.uint32)
    coder = token_output.Coder(token_output.normalise(np.bincount(ids)))
    for n in (0, 1, 7, 1024, 50_000):
        payload = coder.encode(ids[:n], lanes=64, every=16)
        assert (coder.decode(payload) == ids[:n]).all()
    points = token_output.HEAD.unpack_from(payload)[4]
    assert (np.concatenate([coder.decode(payload, k) for k in range(points)]) == ids).all()
    with pytest.raises(ValueError):
        coder.decode(payload[:-1] + bytes([payload[-1] ^ 1]))


@pytest.mark.parametrize("make", [odd_documents, empty_documents])
def test_tokens_of_odd_documents(spark, make):
    from tokenizers import Tokenizer

    docs = make(spark)
    tok = Tokenizer.from_file(Q.tokenizer_path())
    out = token_output.token_output(docs, Q.tokenizer_path(), block_tokens=1000).toPandas()
    want, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert same(out, pd.DataFrame(want, columns=["doc_id", "start", "n_tokens", "ids_crc32"]))


def ids_of(own, texts):
    import pyarrow as pa

    for _, data, bounds in token_output.text_slices(pa.array(texts, pa.string())):
        flat, counts = own.encode(data, bounds)
        ends = np.cumsum(counts)
        yield from (flat[e - c : e - 1].tolist() for e, c in zip(ends.tolist(), counts.tolist()))


def test_cached_tokenizer_equals_the_library():
    """100,000 random strings of white space of all kinds, signs, letters and the special token."""
    import random

    from tokenizers import Tokenizer

    rng = random.Random(4)
    pieces = [" "] * 14 + list("ab'stre.,!0 9-_\n\t\r<|>\x0b\x0c\x1c\x1f\x00\x85\xa0\u2003\u3000\u2028\u1680\u205f\u202f\u200b\ufeff\u2019\u201c\u2014éñ日本йßⅷ²ʰ😀") + ["<|endoftext|>", "\xa0 \xa0 ", " I'll", " don't", "s ", " word", " 12", " .", "0\n"]
    texts = ["", "s  \xa0 \xa0 ", "a  b", " lead", "trail ", "x\n\n y\n z", "it's don't, e.g. 3.14", "...,,, ."] + ["".join(rng.choices(pieces, k=rng.randint(0, 14))) for _ in range(100_000)]
    tok, own = Tokenizer.from_file(Q.tokenizer_path()), token_output.CachedTokenizer(Q.tokenizer_path())
    assert list(ids_of(own, texts)) == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_cached_tokenizer_starts_anew(monkeypatch):
    """Units displace each other in a small table, and a full store of ids is emptied, without a change of ids."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_output, "SLOT_BITS", 4)
    monkeypatch.setattr(token_output, "KNOWN_IDS", 300)
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 400, 60)) for _ in range(40)] + ["x" * 5000 + " 1234567890" * 200]
    tok, own = Tokenizer.from_file(Q.tokenizer_path()), token_output.CachedTokenizer(Q.tokenizer_path())
    assert [i for t in texts for i in ids_of(own, [t])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


# --- mixing


def test_mix_meets_budgets_and_repeats(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = mixing.mix(docs).toPandas()
    per = out.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (per["taken"] == np.floor(per["target"])).all() and (out["taken"] <= 2 * out["size"]).all()
    assert abs(per["target"].sum() - 1.5 * out["size"].sum()) < 1e-3
    assert same(out, mixing.mix(docs).toPandas())


def test_mix_odd_and_documents(spark):
    out = mixing.mix(odd_documents(spark)).toPandas()
    assert len(out) == 10 and (out.loc[out["size"] == 0, "taken"] == 0).all()
    assert mixing.mix(empty_documents(spark)).count() == 0
    mixed = mixing.mixed_documents(odd_documents(spark))
    assert mixed.columns == odd_documents(spark).columns
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in mixed.collect())
    assert words == out["taken"].sum()


# --- secrets, licences


def test_secret_spans(spark):
    text = 'é password = "abc123DEF" token:abc AKIA' + "A" * 16 + " " + "0123456789abcdef" * 2 + " ghp_" + "x" * 36
    docs = spark.createDataFrame([(1, text), (2, None), (None, "TOKEN=token:abcdef")], "doc_id long, text string")
    out = {r.doc_id: r for r in secret_scan.scan(docs).collect()}
    assert (out[1].n_assign, out[1].n_access, out[1].n_hex) == (1, 1, 1)
    spans = dict((s.split(":")[0], tuple(map(int, s.split(":")[1:]))) for s in out[1].spans.split(","))
    assert text[slice(*spans["assign"])] == 'password = "abc123DEF' and text[slice(*spans["github"])].startswith("ghp_")
    assert out[2].base_sha256 == hashlib.sha256(b"").hexdigest() and out[2].spans == ""
    assert secret_scan.scan(empty_documents(spark)).count() == 0 and secret_scan.scan(odd_documents(spark)).count() == 10


def test_trigram_queries_are_necessary():
    for rule in secret_scan.RULES:
        for text in ("api_key=abcdef1", "PassWd : 'xxxxxxxxx", "AKIA" + "B" * 16, "gho_" + "x" * 36, "-----BEGIN RSA PRIVATE KEY-----", "xoxb-" + "1" * 12, "eyJab.eyJcd.ef"):
            if re.search(rule.regex, text):
                assert all(any(all(t in text.lower() for t in s) for s in c) for c in secret_scan.trigram_query(rule.regex))


def test_many_secrets_in_one_text(spark):
    """Offsets over many stretches of matches, and no match at all, against a plain scan."""
    text = " é ".join(f"token={'ab1' * (k % 4)}{k}" for k in range(1500))
    out = secret_scan.scan(spark.createDataFrame([(1, text), (2, "token secret password key=")], "doc_id long, text string")).orderBy("doc_id").collect()
    plain = [f"assign:{m.start()}:{m.end()}" for m in re.finditer(secret_scan.RULES[0].regex, text) if len(m[2]) >= 6]
    assert out[0].spans == ",".join(plain) and out[0].n_assign == len(plain) > 1000 and out[1].spans == ""


def test_licence_bounds_and_odd(spark):
    docs = spark.createDataFrame([(1, "x y z\nReleased under the MIT License.\nq"), (2, "Licensed under the Apache License, Version 2.0. And more words here."), (3, "licence none"), (None, None)], "doc_id long, text string")
    out = {r.doc_id: r.license for r in license_scan.scan(docs).collect()}
    assert out == {1: "MIT", 2: "Apache-2.0"}
    assert license_scan.scan(odd_documents(spark)).count() == 0 and license_scan.scan(empty_documents(spark)).count() == 0


def test_wrapped_notices(spark):
    """Notices wrapped over lines, in comment headers and inside longer paragraphs, a long text and repeated rows."""
    import textwrap

    templates = dict(reversed(license_scan.TEMPLATES))
    long = {name: max((t for n, t in license_scan.TEMPLATES if n == name), key=len) for name in ("MIT", "Apache-2.0", "GPL-3.0", "ISC")}
    rows = []
    for k, (name, text) in enumerate(long.items()):
        lines = textwrap.wrap(text, 60)
        rows.append((10 * k, "Words before it. Copyright me.\n" + "\n".join(lines) + " Words after it go on."))
        rows.append((10 * k + 1, "/*\n * my file\n *\n" + "".join(f" * {x}\n" for x in lines) + " */\nint x;"))
        rows.append((10 * k + 2, "#!/bin/sh\n" + "\n".join(f"# {x}" for x in lines) + "\n\necho"))
    rows.append((99, "word and more. " * 50_000 + templates["CC-BY-4.0"] + " end"))
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")
    got = {(r.doc_id, r.license) for r in license_scan.scan(docs).collect()}
    assert {(10 * k + j, name) for k, name in enumerate(long) for j in range(3)} | {(99, "CC-BY-4.0")} == got


# --- Jaccard join


def brute_jaccard(docs):
    words = [re.findall(r"[0-9A-Za-z_\u0080-\U0010ffff]+", (t or "").lower()) for _, t in docs]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in words]
    return [sum(1 for j, b in enumerate(sets) if j != i and a and b and len(a & b) >= 0.8 * len(a | b)) for i, a in enumerate(sets)]


@pytest.mark.parametrize("small,tile", [(1000, 1024), (3, 4)])
def test_jaccard_equals_brute_force(spark, small, tile):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(60)]
    near = [(10_000 + k, " ".join(w if rng.random() > 0.01 else "other" for w in base)) for k in range(40)]
    both = docs.unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in both.collect()]
    got = {r.doc_id: r.n_links for r in jaccard_join.join(both, small=small, tile=tile).collect()}
    assert [got[i] for i, _ in rows] == brute_jaccard(rows)


def test_jaccard_odd(spark):
    docs = odd_documents(spark)
    out = jaccard_join.join(docs).toPandas()
    assert sorted(out["n_links"]) == [0, 0, 0, 0, 0, 1, 1, 2, 2, 2]
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == 7
    assert jaccard_join.join(empty_documents(spark)).count() == 0


def test_rows_that_stay_are_not_shuffled(spark, monkeypatch):
    """Of each class one row stays, of equal rows too, whatever the filter says; only rows in doubt are shuffled."""
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, text(i)) for i in range(40)] + [(100 + i, text(i)) for i in range(8)] + [(9, text(9))] * 2 + [(50, None), (50, ""), (51, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(i, text(i)) for i in range(40)] + [(51, " ")])
    for bits in (jaccard_join.BLOOM_MOST_BITS, 32):  # a filter of 32 bits takes nearly all rows for doubtful
        monkeypatch.setattr(jaccard_join, "BLOOM_MOST_BITS", bits)
        kept = jaccard_join.keep_one(docs)
        got = [tuple(r) for r in kept.collect()]
        assert sorted(r for r in got if r[0] != 50) == want and [r[0] for r in got].count(50) == 1
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and "Join" not in plan.split("\n:- ")[1].split("\n+- ")[0]


# --- embeddings


@pytest.mark.parametrize("tile", [4096, 16])
def test_embeddings_equal_brute_force(spark, tile):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, base[:20] + 0.1 * rng.standard_normal((20, 16)), np.repeat(base[:1], 30, 0) + 0.05 * rng.standard_normal((30, 16)), base[5:7]]))]
    bad = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None]), (904, []), (None, base[9].tolist())]
    df = spark.createDataFrame([(*r, "x", 1, 2, "t") for r in rows + bad], "vec_id long, embedding array<double>, packed string, addr long, links long, tile string")
    out = embed_dedup.near_duplicates(df, tile=tile).toPandas()
    x = np.array([v for _, v in rows] + [bad[-1][1]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = ((x @ x.T) >= 0.9).sum(1) - 1
    got = out.set_index("vec_id")["n_links"]
    assert [got[i] for i, _ in rows] == want[:-1].tolist()
    assert all(got[i] == 0 for i in range(900, 905)) and len(out) == len(rows) + 6
    near, root = (x @ x.T) >= 0.9, np.arange(len(x))  # the vector without an id is the last: never the smallest
    while True:
        now = np.where(near, root[None, :], len(x)).min(1)
        if (now == root).all():
            break
        root = now
    known = out[out.vec_id.notna()].set_index("vec_id")
    assert [known.component_id[i] for i, _ in rows] == root[:-1].tolist()
    assert [known.kept[i] for i, _ in rows] == [root[i] == i for i, _ in rows] and all(known.kept[i] and known.component_id[i] == i for i in range(900, 905))
    assert out[out.vec_id.isna()].component_id.tolist() == [root[-1]] and not out[out.vec_id.isna()].kept.any()
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_places_of_many_items_stay_small():
    """20,000 items of 60 words over 400,000 terms: tens of MB, and the same bound as by plain sets."""
    import tracemalloc

    rng = np.random.default_rng(3)
    terms = np.unique(rng.integers(0, 1 << 62, 400_000).astype(np.uint64))
    items = [(i, terms[rng.integers(0, len(terms), 60)]) for i in range(20_000)]
    items[7] = (7, np.repeat(items[7][1][:10], 2))  # terms at several places
    items[8] = (8, terms[:70])
    tracemalloc.start()
    places = decontam.Places(items, terms)
    n = 3000
    term = rng.integers(-1, len(terms), n)
    for q, at in ((3, 100), (7, 400), (9, 2950)):
        own = decontam._place(items[q][1], terms)[:40]
        term[at : at + len(own)] = own[: n - at]
    start = rng.integers(0, n - 64, 400)
    start[:4] = (90, 395, 2930, 80)
    item = rng.integers(0, 30, 400)
    item[:4] = (3, 7, 9, 8)
    low, high = np.full(400, 50), np.full(400, n)
    got = places.may_match(term, start, low, high, item, 64, 32)
    assert tracemalloc.get_traced_memory()[1] < 120e6 and not places.row.any()
    tracemalloc.stop()
    for k in range(400):
        words = items[item[k]][1]
        near = set(term[max(50, start[k] - 32) : start[k] + 96].tolist()) - {-1}
        met = sum(t in near for t in decontam._place(words, terms).tolist())
        assert got[k] == (len(words) >= 64 or met >= int(np.ceil(decontam.PARAPHRASE * len(words) - 1e-9)))


def test_members_of_a_family_are_told_apart(spark):
    """The usual notices of each version, wrapped as comments, and both BSD texts in their paragraphs."""
    free = "This {what} is free software{a} you can redistribute it and/or modify\n * it under the terms of the GNU {kind}General Public License as published by\n * the Free Software Foundation{b} either version {v} of the License, or\n * (at your option) any later version."
    wrap = lambda t: f"int main;\n/*\n * {t}\n */\nint other;"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice.\n\n2. Redistributions in binary form must reproduce it.\n\n"
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS.'
    texts = {
        "GPL-2.0": wrap(free.format(what="program", a=";", b=";", kind="", v="2")),
        "GPL-3.0": wrap(free.format(what="program", a=":", b=",", kind="", v="3")),
        "LGPL-2.1": wrap(free.format(what="library", a=";", b=";", kind="Lesser ", v="2.1")),
        "LGPL-3.0": wrap(free.format(what="library", a=":", b=",", kind="Lesser ", v="3")),
        "AGPL-3.0": wrap(free.format(what="program", a=":", b=",", kind="Affero ", v="3")),
        "BSD-2-Clause": bsd + "THIS SOFTWARE IS PROVIDED AS IS.",
        "BSD-3-Clause": bsd + "3. Neither the name of the holder nor the names of its\ncontributors may be used.",
        "Apache-2.0": apache,
    }
    docs = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    got = sorted((r.doc_id, r.license) for r in license_scan.scan(docs).collect())
    assert got == list(enumerate(texts))


# --- pages


def main_blocks(page):
    return html_wrapper.blocks(html_wrapper.parse(page))


def test_html_blocks():
    page = '<html><body><nav>menu</nav><div class="ad">buy</div><article><h1>T &amp; t</h1><p>a\n <b>b</b><br>c<p>d<script>x="</p>"</script></article><div id="comments">no</div><footer>f</footer>'
    assert main_blocks(page) == ["T & t", "a b c", "d"]
    assert main_blocks("<div>" * 3000 + "deep") == ["deep"] and main_blocks("") == []
    assert main_blocks("<div>" * 210 + "<nav>menu</nav>" + "</div>" * 210 + "<p>Hello") == ["Hello"]
    assert main_blocks("<html><head><meta charset=x><title>t</title><body><p>Hello") == ["Hello"] and main_blocks("<head>Hello") == ["Hello"]


def test_class_words_are_evidence_only():
    text = "a long text of the article itself " * 20
    for name in ("layout with-sidebar", "post comments-open", "sidebar", "page-header"):
        assert main_blocks(f'<body><div class="{name}"><p>{text}</p></div><p>short</p>') == [text.strip(), "short"]
    inside = '<div class="entry-header"><h1>T</h1></div><div class="related-work">r</div><div class="widget-review">w</div>'
    outside = '<div class="share-buttons">s</div><div class="related-posts">n</div><div id="comments">c</div><div class="more-related"><a href=x>all links</a></div><form>f</form>'
    assert main_blocks(f"<article>{inside}<p>{text}</p>{outside}</article>") == ["T", "r", "w", text.strip()]
    assert main_blocks(f'<form id="aspnetForm"><p>{text}</p><input><button>b</button></form>') == [text.strip()]


def test_tree_matching_equals_the_plain_recursion(monkeypatch):
    import random

    def tree(r, depth=0):
        return [r.choice("abc"), [tree(r, depth + 1) for _ in range(r.randint(0, 4))] if depth < 4 else []]

    def flat(x):
        out, todo = [[], [], []], [(-1, x)]
        while todo:
            p, (label, kids) = todo.pop()
            todo += [(len(out[0]), k) for k in reversed(kids)]
            for column, v in zip(out, (label, p, None)):
                column.append(v)
        return out

    def weigh(x, y):
        if x[0] != y[0]:
            return 0
        row = [0] * (len(y[1]) + 1)
        for a in x[1]:
            new = [0]
            for j, b in enumerate(y[1]):
                new.append(max(new[-1], row[j + 1], row[j] + weigh(a, b)))
            row = new
        return row[-1] + 1

    r = random.Random(0)
    for k in range(100):
        monkeypatch.setattr(html_wrapper, "CELLS", (4, 1 << 20)[k % 2])
        a, b = tree(r), tree(r)
        fa, fb, pairs = flat(a), flat(b), set(html_wrapper.Shapes().align(flat(a), flat(b)))
        assert len(pairs) == weigh(a, b) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
        assert all(fa[0][i] == fb[0][j] and ((fa[1][i], fb[1][j]) in pairs or not i + j) for i, j in pairs)
        assert [j for _, j in sorted(pairs)] == sorted(j for _, j in pairs)


def test_long_pages_align_in_little_time_and_memory():
    import random
    import time
    import tracemalloc

    trees = []
    for seed in (1, 2):
        r = random.Random(seed)
        trees.append(html_wrapper.skeleton(html_wrapper.parse("".join(f"<section><h2>{r.random()}</h2>{'<p>x</p><div><b>q</b></div>' * r.randint(1, 6)}<ul>{'<li>x</li>' * r.randint(0, 3)}</ul></section>" for _ in range(800)))))
    began = time.process_time()
    assert html_wrapper.Shapes().align(*trees)
    assert time.process_time() - began < 2
    tracemalloc.start()
    html_wrapper.Shapes().align(*trees)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_pages_of_many_shapes(spark):
    """An error page and another layout on the host; clashing names, repeated rows and a long page."""
    page = "<body><div class='x'><p>Same on all</p></div><div class='y'><p>own text {0}</p></div></body>"
    other = "<body><section><p>Other, same on all</p></section><section><h2>{0}</h2><p>body {0}</p><ul><li>z</li></ul></section></body>"
    html = [page.format(i) for i in range(8)] + [other.format(i) for i in range(8)] + ["<p>Not found</p>", page.format("long " * 40_000), page.format(0)]
    rows = [(i, f"http://h.example/{i}", h, "t", 1) for i, h in enumerate(html)]
    df = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string, Main_Text string, host int")
    out = html_wrapper.extract(df, html_wrapper.induce(df))
    assert out.columns == ["page_id", "url", "html", "host", "main_text", "main_chars"]
    got = out.toPandas().set_index("page_id")["main_text"]
    assert len(got) == 20 and got[3] == "own text 3" and got[9] == "1\n\nbody 1" and got[16] == "Not found" and set(got[0]) == {"own text 0"}
    assert got[17] == "own text " + " ".join(["long"] * 40_000)


def test_wrapper_drops_constant_blocks(spark):
    pages = [(i, f"http://h.example/{i}", f"<body><div class='x'><p>Same on all</p></div><div class='y'><p>own text {i}</p></div></body>") for i in range(8)]
    pages += [(100, None, None), (101, "not a url", "<p>plain</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = {r.page_id: r.main_text for r in html_wrapper.extract(df, html_wrapper.induce(df)).collect()}
    assert out[3] == "own text 3" and out[100] == "" and out[101] == "plain"
    assert html_wrapper.extract(df.limit(0), html_wrapper.induce(df.limit(0))).count() == 0


def test_copies_are_not_template(spark):
    page = "<body><div class='x'><p>Same on all</p></div><article><h1>{0}</h1><p>text of {0}</p></article></body>"
    titles = ["copied"] * 6 + ["other"] + [f"own {i}" for i in range(6)]
    hosts = ["few"] * 7 + ["many"] * 6
    rows = [(i, f"http://{h}.example/{i}", page.format(t)) for i, (h, t) in enumerate(zip(hosts, titles))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    wrappers = html_wrapper.induce(df)
    import json

    texts = {r.host: json.loads(r.template)[1] for r in wrappers.collect()}
    assert not texts["few.example"] and texts["many.example"]
    out = {r.page_id: r.main_text for r in html_wrapper.extract(df, wrappers).collect()}
    assert [out[i] for i in range(13)] == [f"{t}\n\ntext of {t}" for t in titles]


def test_text_that_markup_hid():
    """Self-closed svg, a quote inside an unquoted value, a teaser's article, a class that means something else."""
    assert main_blocks('<p>One</p><svg width="1"/><p>Two</p><svg><g><text>no</text></g><path d="x"/></svg><p>Three') == ["One", "Two", "Three"]
    assert main_blocks("<p data-x=it's>Hello</p><p title=\"a>b\">x</p><p 'y>z'</p>") == ["Hello", "x", "z'"]
    long = "the text of the page itself " * 20
    assert main_blocks(f"<body><h1>T</h1><p>{long}</p><article><p>Teaser</p></article></body>") == ["T", long.strip(), "Teaser"]
    assert main_blocks(f'<article><p>{long}</p></article><div class="cookies recipe"><p>Bake.</p></div>') == [long.strip()]
    assert main_blocks(f'<p>{long}</p><div class="cookies recipe"><p>Bake.</p></div>') == [long.strip(), "Bake."]
    assert main_blocks(f'<p>{long}</p><div class="cookies css-1x2y3z"><p>Accept.</p></div>') == [long.strip()]


def plain_divs(html):
    """Pages that say nothing by tags and classes."""
    html = re.sub(r"<(article|main|nav|footer|header|aside)\b", "<div", html)
    return re.sub(r' (class|id|role)="[^"]*"', "", re.sub(r"</(article|main|nav|footer|header|aside)>", "</div>", html))


def test_main_slot_stands_for_tags_and_classes(spark):
    """Without a word from tags and classes the aligned pages of a host tell its article; a page alone can't."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    want = {r.page_id: r.main_text for r in html_wrapper.extract(pages, html_wrapper.induce(pages)).collect()}
    rows = [(r.page_id, r.url, plain_divs(r.html)) for r in pages.collect()]
    plain = spark.createDataFrame(rows, pages.schema)
    wrappers = html_wrapper.induce(plain)
    host = {r.page_id: r.host for r in pages.select("page_id", html_wrapper.host_of().alias("host")).collect()}
    many = {h for h in host.values() if list(host.values()).count(h) >= 5}
    ids = [i for i in host if host[i] in many]
    with_, without = ({r.page_id: r.main_text for r in html_wrapper.extract(plain, w).collect()} for w in (wrappers, wrappers.limit(0)))
    assert len(ids) > 100 and sum(with_[i] == want[i] for i in ids) >= 0.95 * len(ids)
    assert sum(without[i] == want[i] for i in ids) <= 0.1 * len(ids)


def test_main_slot_moves_with_the_tree(spark):
    """An advert before the article on some pages, one page's article shorter than its advert, copies, and a headline kept with its text."""
    nav = "<div><ul>" + "".join(f"<li><a href=/{k}>item {k}</a></li>" for k in range(5)) + "</ul></div>"
    page = "<body>{nav}{ad}<div><h1>Title {i}</h1><div><p>{text}</p><p>more {i}</p></div></div><div><p>&copy; site {i}</p></div></body>"
    rows = []
    for i in range(12):
        text = "Short." if i == 4 else f"words of page {i} " * 12
        ad = f"<div><p>Buy {i} now, it is cheap and very good for you and all your friends.</p></div>" if i % 3 else ""
        rows.append((i, f"https://s.example/{i}", page.format(nav=nav, ad=ad, i=i, text=text)))
    df = spark.createDataFrame([*rows, *[(100 + k, "https://s.example/copy", rows[1][2]) for k in range(9)]], "page_id long, url string, html string")
    out = {r.page_id: r.main_text for r in html_wrapper.extract(df, html_wrapper.induce(df)).collect()}
    for i in range(12):
        text = "Short." if i == 4 else (f"words of page {i} " * 12).strip()
        assert out[i] == f"Title {i}\n\n{text}\n\nmore {i}"
    assert {out[100 + k] for k in range(9)} == {out[1]}


def test_html_of_test_pages(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas().set_index("page_id")
    for r in Q.QUERIES["op2_html_wrapper"](spark, SF).collect():
        article = re.search(r"<article>(.*)</article>", pages.html[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_warc_round_trip(spark):
    big = "é<p>\r\n\r\nWARC/1.1\r\n" * 4000
    pages = [(3, "http://a/\r\nx", big), (1, None, "same"), (2, "u", "same"), (5, "u", None), (4, "u", ""), (None, "u", "lone"), (9, "u", big)]
    out = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(out) == 7 and all(r.status == "ok" for r in out.values())
    assert bytes(out[3].payload) == big.encode() and out[9].record_type == "revisit" and out[9].refers_to == 3
    assert (out[1].record_type, out[2].refers_to, out[5].refers_to) == ("response", 1, 4)
    assert out[9].payload_bytes == len(big.encode()) and out[9].payload_digest == out[3].payload_digest == warc.b32_sha1(big.encode())
    assert warc.dechunk(b"4;x=1\r\nWiki\r\n0\r\n\r\n") == b"Wiki"


def test_warc_odd(spark):
    """One id twice with two urls, equal rows, lone null ids, clashing names, no rows at all."""
    big = "<p>text</p>" * 3000
    pages = [(1, "http://a/", big), (1, "http://b/", big), (2, "http://c/", big), (3, "u", "same"), (3, "u", "same"), (None, "n", "null"), (None, "n", "null"), (None, "m", big)]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, first string, payload int")
    out = warc.round_trip(df).toPandas()
    assert sorted(out["url"]) == sorted(u for _, u, _ in pages) and set(out["status"]) == {"ok"}
    assert sorted(out.loc[out["record_type"] == "revisit", "url"]) == ["http://c/", "m"] and set(out["refers_to"].dropna()) == {1}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_missing_segment_is_told():
    head = warc.page_records(1, "u", b"x" * 5000, None, None, False, 1000, 1 << 30)
    rows = []
    for h, block in (next(warc.parse(r + b"\r\n\r\n")) for r in head[:2] + head[3:]):
        rows.append({"segment": int(h["warc-segment-number"]), "kind": h["warc-type"], "page_id": 1, "url": "u", "digest": h.get("warc-payload-digest", "")[5:], "total": int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, "block": bytes(block)})
    import pyarrow as pa

    out = next(warc._reassemble([pa.RecordBatch.from_pylist([{"parts": rows}])])).to_pylist()
    assert out[0]["status"] == "bad total length"


# --- toxicity, decontamination


def test_toxicity_held_out():
    rng = np.random.default_rng(5)
    vocab = [f"word{i}" for i in range(3000)]
    texts, labels = [], []
    for i in range(600):
        w = list(rng.choice(vocab, 120))
        y = int(i % 3 == 0)
        if y:
            for k in range(3):
                w[int(rng.integers(120))] = str(rng.choice(["vilest", "vilething", "vilely", "awfulone"]))
        texts.append(" ".join(w))
        labels.append(y)
    import pyarrow as pa

    model = toxicity.train(texts[:400], labels[:400])
    score = np.concatenate([toxicity._score_slice(model, d, b)[0] for _, d, b in token_output.text_slices(pa.array(texts[400:]))])
    assert ((score >= 0.7) == (np.array(labels[400:]) == 1)).mean() > 0.98


def test_marginals_equal_enumeration():
    import itertools

    s, trans = np.array([0.3, -1.0, 2.0, 0.5]), np.array([0.1, -0.2, 0.3, 0.7])
    total, on = 0.0, np.zeros(4)
    for y in itertools.product((0, 1), repeat=4):
        p = np.exp(sum(s[i] * y[i] for i in range(4)) + sum(trans[2 * y[i] + y[i + 1]] for i in range(3)))
        total += p
        on += p * np.array(y)
    assert np.allclose(toxicity.marginals(s, np.array([0, 4]), trans), on / total)


def test_toxicity_odd(spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    for docs in (odd_documents(spark), empty_documents(spark)):
        model = toxicity.fit(docs, labels)
        assert toxicity.score(docs, model).count() == docs.count()
    assert toxicity.reject(odd_documents(spark), labels.limit(0)).count() == 10


def test_leaks_equal_brute_force(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    texts, items = [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()]
    want = {(d, i) for d, t in texts for i, b in items if b in t}
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()}
    assert want <= got and len(got - want) <= 0.1 * len(want) + 1


def test_paraphrase_needs_the_answer(spark):
    item = "one two three four five six seven eight nine ten eleven twelve the answer is forty two indeed today ok"
    words = item.split()
    para = " ".join(w if i % 4 or i > 14 else "changed" for i, w in enumerate(words))
    lost = " ".join(w if i < 13 else "gone" for i, w in enumerate(words))
    rng = np.random.default_rng(1)
    noise = [(100 + k, " ".join(f"n{j}" for j in rng.integers(0, 500, 80))) for k in range(30)]
    docs = spark.createDataFrame([(1, f"x y {item} z"), (2, f"p q {para} r"), (3, f"a b {lost} c"), (4, None), (5, ""), *noise], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    assert {r.doc_id for r in decontam.find_leaks(docs, bench).collect()} == {1, 2}
    assert decontam.decontaminate(docs, bench).count() == 33
    odd = docs.selectExpr("cast(null as long) as doc_id", "text", "doc_id as __leak_id", "text as Item_ID")
    assert {r["__leak_id"] for r in decontam.decontaminate(odd, bench).collect()} == {3, 4, 5, *range(100, 130)}
    assert decontam.find_leaks(docs, bench.limit(0)).count() == 0 and decontam.find_leaks(docs.limit(0), bench).count() == 0


def test_leaks_equal_brute_force_of_the_rule(spark):
    """The opening without the answer and, elsewhere, a paraphrase with it, against all stretches of each text."""
    item = [f"t{i}" for i in range(20)]
    opening = [*item[:15], *["gone"] * 30]
    paraphrase = [w if i >= 15 or i % 2 == 0 else f"c{i}" for i, w in enumerate(item)]
    noise = lambda k: [f"n{k}x{j}" for j in range(90)]
    parts = [opening, paraphrase, [*opening, *noise(1), *paraphrase], [*paraphrase, *noise(2), *opening], [*opening, *paraphrase], [*noise(3), *opening], item, item[:12]]
    docs = [(k, p) for k, p in enumerate(parts)] + [(100 + k, noise(k + 10)) for k in range(20)]

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *[max(row[j], row[j + 1], 0) if x != y else row[j] + 1 for j, y in enumerate(b)]]
            for j in range(1, len(row)):
                row[j] = max(row[j], row[j - 1])
        return row[-1]

    span = int(decontam.LOOSE * len(item)) + 2
    answer = item[-max(1, round(decontam.ANSWER_PART * len(item))) :]
    stretches = {d: [w[s : s + span] for s in range(max(1, len(w) - span + 1))] for d, w in docs}
    want = {d for d, all_ in stretches.items() if any(decontam.leaks(common(item, s) / len(item), common(answer, s) / len(answer)) for s in all_)}
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert {r.doc_id for r in decontam.find_leaks(frame, bench).collect()} == want and {2, 3} <= want and not {0, 5, 100} & want


def test_held_out_labels_are_not_learned(spark):
    """Turning every held-out label round changes no score of the query's model."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")).cast(labels.schema["toxic"].dataType))
    one, other = (toxicity.fit(docs, x.where(~toxicity.held_out())) for x in (labels, turned))
    a, b = (toxicity.score(docs.select("doc_id", "text"), m).toPandas().set_index("doc_id")["toxic_score"] for m in (one, other))
    assert (a.sort_index() == b.sort_index()).all()


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert P.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert [f(spark, docs, SF).columns == docs.columns for _, f in P.STAGES[:4]] == [True] * 4


def test_pipeline_stages_equal_brute_force(spark):
    """Each filtering stage against plain Python on its own input."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    stages = dict(P.STAGES)
    scores = {r.doc_id: r.predicted for r in Q.QUERIES["op1_toxicity"](spark, SF).collect()}
    assert {r.doc_id for r in stages["toxicity"](spark, docs, SF).collect()} == {d for d, p in scores.items() if not p}
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := re.findall(r"[0-9A-Za-z_\u0080-\U0010ffff]+", (t or "").lower())) else frozenset() for _, t in rows]
    top = {d: d for d, _ in rows}
    changed = True
    while changed:  # classes by plain spreading of the smallest id
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and len(a & b) >= 0.8 * len(a | b) and top[rows[j][0]] < top[rows[i][0]]:
                    top[rows[i][0]], changed = top[rows[j][0]], True
    assert {r.doc_id for r in stages["near copies"](spark, docs, SF).collect()} == {d for d in top if top[d] == d}
    bad = {r.doc_id for r in Q.QUERIES["op6_decontamination"](spark, SF).select("doc_id").collect()}
    left = {r.doc_id for r in stages["benchmark decontamination"](spark, docs, SF).collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert left == {d for d, _ in rows} - bad and not any(i in t for d, t in rows if d in left for i in items)
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    words = {}
    for r in stages["source mixing"](spark, docs, SF).collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert words == {d: n for d, n in taken.items() if n}


def test_pipeline_stages_on_odd_documents(spark):
    import corpus_pipeline as P
    from pyspark.sql import functions as F

    odd = odd_documents(spark).withColumns({"Toxic_Score": F.lit("t"), "row": F.lit(1), "__leak_": F.lit(2)})
    counts = {"toxicity": 10, "near copies": 7, "benchmark decontamination": 10}
    for docs in (odd, odd.limit(0)):
        for name, stage in P.STAGES:
            out = stage(spark, docs, SF)
            n = out.count()
            assert n == 0 if docs is not odd else n == counts.get(name, n)
            assert name == "token output" or out.columns == docs.columns




def test_axes_come_from_all_passages(spark):
    """The axes are those of an exact SVD of all passages; with fewer axes than terms they hold nearly as much as the best ones."""
    rng = np.random.default_rng(5)
    items = [" ".join(f"t{t}" for t in rng.integers(0, 60, 12)) for _ in range(6)]
    texts = [" ".join(f"t{t}" for t in rng.zipf(1.4, 150).clip(0, 90)) for _ in range(300)] + ["", None, "other words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = decontam._words(items)
    model = decontam.fit(docs, words, rank=100)
    at, idf = {t: i for i, t in enumerate(model["terms"].tolist())}, model["idf"]
    rows = []
    for w in decontam._words([t or "" for t in texts]):
        for i in range(0, len(w), decontam.WINDOW):
            row = np.zeros(len(idf))
            for t in w[i : i + decontam.WINDOW].tolist():
                if t in at:
                    row[at[t]] += idf[at[t]]
            if row.any():
                rows.append(row / np.linalg.norm(row))
    assert len(rows) > 3 * decontam.LEAST_WEIGHT
    gram = np.array(rows).T @ np.array(rows) * decontam.LEAST_WEIGHT / len(rows)
    for w in words:
        row = np.zeros(len(idf))
        for t in w.tolist():
            row[at[t]] += idf[at[t]]
        gram += np.outer(row, row) / (row @ row)
    axes = model["vectors"] / idf[:, None]
    assert np.allclose(axes.T @ axes, np.eye(axes.shape[1]), atol=1e-4)
    best, vectors = np.linalg.eigh(gram)
    assert abs(vectors[:, -1] @ axes[:, 0]) > 1 - 1e-6
    held = lambda a: np.trace(a.T @ gram @ a)
    assert held(axes[:, :12]) > 0.9999 * best[-12:].sum()
    few = decontam.fit(docs, words, rank=12)["vectors"] / idf[:, None]
    assert few.shape[1] == 12 and held(few) > 0.95 * best[-12:].sum()


def test_mix_carries_rows_without_a_shuffle(spark):
    """Whole rows aren't dealt by key: the place of each source's last row tells the part of all others; ties too."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, " ".join(["w"] * (1 + i % 7)), "en", f"s{i % 3}", 9) for i in range(200)], "doc_id long, text string, lang string, source string, n_chars long")
    same = spark.createDataFrame([(None, "p q r s t", "en", "s1", 9)] * 50, docs.schema)
    plan = mixing.mixed_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan
    for d in (docs, docs.unionByName(same), same):
        taken = mixing.mix(d, carry=True)
        got = sorted(map(str, taken.drop("row").collect()))
        assert got == sorted(map(str, mixing.mix(d).collect()))
        total = {r[0]: r[1] for r in taken.groupBy("source").agg(F.sum("taken")).collect()}
        assert total == {r[0]: int(r[1]) for r in taken.select("source", "target").distinct().collect()}
