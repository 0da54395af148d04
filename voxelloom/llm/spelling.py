"""Spelling variants: words one edit apart, grouped by the form that is far more frequent.

A word's mask holds for every letter the parity of its count. A replaced letter flips two bits of
it, an inserted or deleted one flips one. The letters are dealt to three bands, so at least one band
of two near words is equal. Words meet by their lengths and by what stays equal: two whole bands
where all flips are in the third, else one band and the half of another. Every near pair has exactly
one such bucket. Pairs whose masks differ in other bits or whose halves both differ fall out inside the
join, the rest is verified by edit distance there, so only near words leave it. Large buckets are cut into
blocks, so no task holds a whole bucket, whatever its size.

A form's count is at least twice its word's, so forms can be followed by pointer doubling in as many
rounds as the logarithm of the logarithm of the greatest count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = LOWER + "".join(chr(c) for c in range(0xC0, 0x100))
LEAST_CHARS = 5
LEAST_COUNT = 3
FACTOR = 2
#: One in so many (document, run) pairs loses a letter.
MISPRINT = 97
BANDS = 3
#: Every other bit of a band: its letters stand by frequency, so both halves tell about as much.
HALVES = (0x15555555, 0x2AAAAAAA)
#: Words of one bucket that meet in one group.
BLOCK = 4096


def words(docs: DataFrame) -> DataFrame:
    """(word, n): the words of docs(doc_id, text, ...) after misprints, counted over all rows.

    A run of letters loses its letter h % length where MISPRINT divides h, the CRC-32 of
    `<doc_id>:<run>`; a null id counts as empty. Null and empty texts have no runs; repeated rows
    count each.
    """
    text = F.translate("text", UPPER, LOWER)  # A-Z only
    runs = F.regexp_extract_all(text, F.lit("[a-zÀ-ÿ]+"), F.lit(0))
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    run = run.where(F.char_length("run") >= LEAST_CHARS)  # a misprint only shortens
    run = run.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    without = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    word = F.when(F.col("h") % MISPRINT == 0, without).otherwise(F.col("run"))
    counted = run.select(word.alias("word")).where(F.char_length("word") >= LEAST_CHARS)
    return counted.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def bands(vocabulary: DataFrame) -> list[str]:
    """LETTERS dealt to BANDS in turns by falling frequency, so that the bands tell words apart equally well."""
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").count()
    counts = dict(letters.where(F.col("c").isin(list(LETTERS))).collect())  # one row a letter
    order = sorted(LETTERS, key=lambda c: (-counts.get(c, 0), c))
    turns = [*range(BANDS), *reversed(range(BANDS))]
    return ["".join(c for i, c in enumerate(order) if turns[i % len(turns)] == b) for b in range(BANDS)]


def mask(word: Column, band: str) -> Column:
    """Bit i: the parity of the count of the band's letter i."""
    bits = F.create_map(*[x for i, c in enumerate(band) for x in (F.lit(c), F.lit(1 << i))])
    return F.aggregate(F.split(word, ""), F.lit(0), lambda acc, c: acc.bitwiseXOR(F.coalesce(F.element_at(bits, c), F.lit(0))))


def _meet(left: DataFrame, right: DataFrame, bucket: list[str], condition: Column) -> DataFrame:
    """(a, a_n, b, b_n) of the rows of equal buckets that meet the condition on `l` and `r`.

    The right side of a large bucket is cut into blocks of about BLOCK rows, the left side goes to
    each of them. Large buckets are at most a BLOCK-th of the rows.
    """
    sizes = right.groupBy(*bucket).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    large = materialise(sizes.where("blocks > 1"), "large-buckets")
    blocks = F.coalesce("blocks", F.lit(1))
    left = left.join(large, bucket, "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    right = right.join(large, bucket, "left").withColumn("block", F.pmod(F.xxhash64("word"), blocks).cast("int"))
    # Work grows with pairs, not bytes: a stated number of partitions isn't merged to large ones.
    keys, parts = [*bucket, "block"], int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (side.repartition(parts, *keys) for side in (left, right))
    met = left.alias("l").hint("merge").join(right.alias("r"), [F.col(f"l.{c}") == F.col(f"r.{c}") for c in keys] + [condition])
    return met.select(F.col("l.word").alias("a"), F.col("l.n").alias("a_n"), F.col("r.word").alias("b"), F.col("r.n").alias("b_n"))


def near(vocabulary: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): all pairs of vocabulary(word, n) that differ by exactly one inserted, deleted or replaced code point, once each.

    Words are unique and made of LETTERS.
    """
    masks = [mask(F.col("word"), band).alias(f"m{k}") for k, band in enumerate(bands(vocabulary))]
    masked = materialise(vocabulary.select("word", "n", F.char_length("word").alias("length"), *masks), "masks")

    def flips(name: str) -> Column:
        return F.bit_count(F.col(f"l.{name}").bitwiseXOR(F.col(f"r.{name}")))

    # One edit leaves the first half or the rest of the shorter word in place: hashes of both go before the edit distance.
    edit = ((F.col("l.first") == F.col("r.first")) | (F.col("l.rest") == F.col("r.rest"))) & (F.levenshtein(F.col("l.word"), F.col("r.word"), 1) == 1)

    def ends(rows: DataFrame) -> DataFrame:
        half = F.floor(F.col("length") / 2).cast("int")
        return rows.withColumns({"first": F.hash(F.left("word", half)), "rest": F.hash(F.right("word", F.col("length") - half))})

    # Turn k: the bands by their distance from band k on.
    turned = [F.struct(F.lit(k).alias("k"), *[F.col(f"m{(k + i) % BANDS}").alias(n) for i, n in enumerate("xyz")]) for k in range(BANDS)]
    rows = masked.select("word", "n", "length", F.explode(F.array(*turned)).alias("t")).select("word", "n", "length", "t.*")

    # Bands y and z equal, both flips or the only one in x.
    bucket = ["k", "y", "z", "length"]
    whole, longer = ends(rows), ends(rows.withColumn("length", F.col("length") - 1))
    within = _meet(whole, whole, bucket, (flips("x") == 2) & (F.col("l.word") < F.col("r.word")) & edit)
    inserted = _meet(whole, longer, bucket, (flips("x") == 1) & edit)

    # Band x equal, one flip in y and one in z: their bit counts change parity, and one half of y stays equal.
    odd = lambda c: F.bit_count(c).bitwiseAND(F.lit(1))
    halves = [F.struct(F.lit(h).alias("half"), F.col("y").bitwiseAND(F.lit(bits)).alias("equal")) for h, bits in enumerate(HALVES)]
    halved = whole.withColumn("h", F.explode(F.array(*halves))).select("*", "h.*", odd(F.col("z")).alias("odd")).drop("h")
    even, uneven = (halved.where(odd(F.col("y")) == v) for v in (0, 1))
    bucket = ["k", "x", "half", "equal", "odd", "length"]
    across = _meet(even, uneven.withColumn("odd", 1 - F.col("odd")), bucket, (flips("y") == 1) & (flips("z") == 1) & edit)
    return within.unionByName(inserted).unionByName(across)


def roots(forms: DataFrame) -> DataFrame:
    """forms(word, form), without rings -> (word, root): the last of each word's forms.

    Every round doubles the steps that a row has taken, so chains of n words take about log2(n)
    rounds; each is one equi-join, written to the shared folder.
    """
    now = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = materialise(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """Per word of docs(doc_id, text, ...): word, n, n_near, form, form_n, root.

    form is the near word of the greatest count (ties: the smallest in code-point order) if that is
    at least FACTOR times the word's; else null, and the word is its own root. What words() says of
    odd rows holds; without words the result is empty; other columns aren't read. A frequent word is
    counted per task first; words are unique from then on.
    """
    vocabulary = materialise(words(docs.select("doc_id", "text")), "words")
    pairs = materialise(near(vocabulary), "near-words")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = F.min(F.struct((-F.col("b_n")).alias("less"), "b"))
    linked = both.groupBy(F.col("a").alias("word")).agg(F.first("a_n").alias("n"), F.count("*").alias("n_near"), best.alias("best"))
    known = -F.col("best.less") >= FACTOR * F.col("n")
    linked = linked.select("word", "n_near", F.when(known, F.col("best.b")).alias("form"), F.when(known, -F.col("best.less")).alias("form_n"))
    linked = materialise(linked, "word-forms")
    last = roots(linked.where("form is not null").select("word", "form"))
    out = vocabulary.join(linked, "word", "left").join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


#: CRC-32's reflected generator polynomial: a fixed value.
POLYNOMIAL = 0xEDB88320


def oracle_sql() -> str:
    """The same in DuckDB: CRC-32 byte by byte, near words by equal rests after one letter is taken out."""
    codes = "list_transform(string_split(s, ''), lambda c: unicode(c))"
    # UTF-8: ASCII is one byte, U+0080 to U+07FF are two.
    utf8 = f"flatten(list_transform({codes}, lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 + (u >> 6), 128 + (u & 63)] END))"
    step = "(CASE WHEN c & 1 = 1 THEN xor(c >> 1, {p}) ELSE c >> 1 END)"
    rounds = "".join(f", t{k + 1} AS (SELECT i, {step.format(p=POLYNOMIAL)} AS c FROM t{k})" for k in range(8))
    return f"""
WITH RECURSIVE t0 AS (SELECT i, i::BIGINT AS c FROM range(256) r(i)){rounds},
tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS tab FROM t8),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
once AS (SELECT id || ':' || run AS s, run, count(*) AS times FROM runs WHERE length(run) >= {LEAST_CHARS} GROUP BY ALL),
hashed AS (SELECT run, times, xor(4294967295, list_reduce({utf8}, lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]), 4294967295::BIGINT)) AS h FROM once, tab),
printed AS (SELECT CASE WHEN h % {MISPRINT} = 0 THEN run[:(h % length(run))::INT] || run[(h % length(run))::INT + 2:] ELSE run END AS word, times FROM hashed),
v AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM printed WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(times) >= {LEAST_COUNT}),
gaps AS MATERIALIZED (SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT a.word AS a, b.word AS b, b.n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, v.word, v.n FROM gaps g JOIN v ON g.rest = v.word
  UNION SELECT v.word, g.word, g.n FROM gaps g JOIN v ON g.rest = v.word),
best AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY p.n DESC, b) AS form, max(p.n) AS form_n FROM p GROUP BY a),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= {FACTOR} * v.n THEN form END AS form, CASE WHEN form_n >= {FACTOR} * v.n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON chain.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, chain.at AS root, f.n, f.n_near, f.form_n
FROM f JOIN chain ON f.word = chain.word JOIN f AS last ON last.word = chain.at AND last.form IS NULL
"""
