"""Secret scans with a trigram inverted index; DataFrame functions only.

Each rule's regular expression gives a Boolean trigram query: an AND of clauses, each an OR of
sets of trigrams that must all occur. The index has, per block of texts and trigram, the posting
list of text keys. Postings are intersected and united per block; only candidates are verified by
the expression itself. A rule with no mandatory trigram (hex) scans every text.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass
from re import _constants as C
from re import _parser as P

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise


@dataclass(frozen=True)
class Rule:
    """kind; regex as Java and Python both read it; least characters of the group that counts."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    base: bool = True


# Fixed patterns, in the order in which spans of equal start are listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("private_key", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", base=False),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}", base=False),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", base=False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", base=False),
)
MOST_STRINGS = 64
TRIGRAMS_EACH = 2
#: Characters by falling frequency; others count as common.
COMMON = "etaoinshrdlcumwfgypbvkjxqz-_"
MATCHES_AT_ONCE = 256
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
TEXTS_PER_BLOCK = 20_000


# --- trigram queries -------------------------------------------------------------------------


def _exact(op, arg) -> set[str] | None:
    """All strings that an element can match, in lower case, if they are few."""
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.IN:
        out = set()
        for o, a in arg:
            if o is C.LITERAL:
                out.add(chr(a).lower())
            elif o is C.RANGE and a[1] - a[0] < 8:
                out |= {chr(x).lower() for x in range(a[0], a[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is C.BRANCH:
        sets = [_strings(b) for b in arg[1]]
        return None if None in sets else set().union(*sets)
    if op is C.SUBPATTERN:
        return _strings(arg[-1])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, body = arg
        one = _strings(body)
        if one is not None and high != C.MAXREPEAT and high <= 3:
            out = set()
            for n in range(low, high + 1):
                out |= {"".join(t) for t in itertools.product(one, repeat=n)}
            return out if len(out) <= MOST_STRINGS else None
    return None


def _strings(items) -> set[str] | None:
    out = {""}
    for op, arg in items:
        one = _exact(op, arg)
        if one is None or len(out) * len(one) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in one}
    return out


def _rarest(string: str) -> frozenset[str]:
    """The trigrams of a string that few texts hold: at most TRIGRAMS_EACH, by their letters' rank in common text."""
    all_ = {string[i : i + 3] for i in range(len(string) - 2)}
    rank = lambda t: (-sum(max(0, COMMON.find(c)) for c in t), t)
    return frozenset(sorted(all_, key=rank)[:TRIGRAMS_EACH])


def trigram_query(regex: str) -> list[set[frozenset[str]]]:
    """AND of clauses; a clause is an OR of sets of trigrams. Empty: no mandatory trigram.

    Fewer trigrams of a string make a weaker condition, never a wrong one.
    """
    clauses: list[set[frozenset[str]]] = []

    def close(strings: set[str]) -> None:
        if all(len(s) >= 3 for s in strings):
            sets = {_rarest(s) for s in strings}
            clauses.append({s for s in sets if not any(o < s for o in sets)})

    def walk(items) -> None:
        run = {""}
        for op, arg in items:
            one = _exact(op, arg)
            if one is not None and len(run) * len(one) <= MOST_STRINGS:
                run = {a + b for a in run for b in one}
                continue
            close(run)
            run = one if one is not None else {""}
            if one is None and op is C.SUBPATTERN:
                walk(arg[-1])
            elif one is None and op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
                walk(arg[2])
        close(run)

    walk(P.parse(regex))
    return clauses


# --- index -----------------------------------------------------------------------------------


def build_index(docs: DataFrame, trigrams: list[str], blocks: int) -> DataFrame:
    """Posting lists: (block, trigram, keys) over the whole text of every row.

    Inside a lambda the text is put in lower case once for all trigrams.
    """
    have = F.flatten(F.transform(F.array(F.lower("text")), lambda low: F.filter(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams]), lambda t: t.isNotNull())))
    hits = docs.select(F.xxhash64("text").alias("key"), F.explode(have).alias("trigram"))
    block = F.pmod("key", F.lit(blocks)).cast("int")
    return hits.groupBy(block.alias("block"), "trigram").agg(F.collect_set("key").alias("keys"))


def candidates(index: DataFrame, queries: dict[str, list[set[frozenset[str]]]]) -> DataFrame:
    """(key, rules): the texts whose postings meet a rule's query, block by block."""
    per_block = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("postings"))
    none = F.array().cast("array<bigint>")

    def posting(t: str) -> Column:
        return F.coalesce(F.element_at("postings", F.lit(t)), none)

    def all_of(columns: list[Column], join) -> Column:
        out = columns[0]
        for c in columns[1:]:
            out = join(out, c)
        return out

    met = {}
    for kind, clauses in queries.items():
        either = [all_of([all_of([posting(t) for t in sorted(s)], F.array_intersect) for s in sorted(c, key=sorted)], F.array_union) for c in clauses]
        met[kind] = all_of(either, F.array_intersect)
    pairs = per_block.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("keys")) for k, c in met.items()])).alias("m"))
    return pairs.select(F.explode("m.keys").alias("key"), F.col("m.kind").alias("kind")).groupBy("key").agg(F.collect_set("kind").alias("rules"))


# --- verification ----------------------------------------------------------------------------


def _spans(rule: Rule, rank: int, text: Column) -> Column:
    """array<struct<start, rank, end, kind>> of a rule's matches that are long enough.

    The pieces between the matches and the matches themselves give code-point offsets: summed up
    inside stretches of MATCHES_AT_ONCE matches and then over stretches, so that a text of very
    many matches isn't copied once for each.
    """
    regex = rule.regex
    if rule.kind == "hex":
        regex = f"[0-9a-f]{{{rule.least},}}"  # a match is a whole run, so shorter runs can be passed over
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(regex), F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, regex, -1)
    parts = F.arrays_zip(found.alias("m"), counted.alias("g"), F.slice(gaps, 1, F.size(found)).alias("gap"))
    schema = f"struct<at:int,out:{SPANS}>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out")).cast(schema)

    def span(begin, end):
        return F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))

    def step(acc, p):
        begin = acc["at"] + F.char_length(p["gap"])
        end = begin + F.char_length(p["m"])
        return F.struct(end.alias("at"), F.when(F.char_length(p["g"]) >= rule.least, F.concat(acc["out"], F.array(span(begin, end)))).otherwise(acc["out"]).alias("out")).cast(schema)

    many = F.greatest(F.ceil(F.size(found) / F.lit(MATCHES_AT_ONCE)).cast("int"), F.lit(1))
    stretches = F.transform(F.sequence(F.lit(0), many - 1), lambda k: F.aggregate(F.slice(parts, k * MATCHES_AT_ONCE + 1, F.lit(MATCHES_AT_ONCE)), start, step))
    before = F.aggregate(stretches, F.array(F.lit(0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s["at"])))
    moved = F.zip_with(stretches, before, lambda s, b: F.transform(s["out"], lambda x: span(x["start"] + b, x["end"] + b)))
    return F.flatten(F.slice(moved, 1, many)).cast(SPANS)


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """Secrets in the whole text of every row of docs(doc_id, text, ...).

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans. Null text is empty: no spans
    and the digest of an empty string. Null or repeated ids and repeated rows each give their own
    row; an empty table gives none; further columns aren't read. Texts are keyed by a 64-bit hash:
    a collision could only add a candidate, which verification then rejects.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex))}
    trigrams = sorted({t for q in queries.values() for c in q for s in c for t in s})
    blocks = max(64, math.ceil(docs.count() / TEXTS_PER_BLOCK))
    index = materialise(build_index(docs, trigrams, blocks), "trigram-index")
    found = materialise(candidates(index, queries), "secret-candidates")
    none = F.array().cast(SPANS)
    text = F.col("text")
    joined = docs.withColumn("key", F.xxhash64("text")).join(found, "key", "left")
    spans = []
    for rank, rule in enumerate(rules):
        if rule.kind in queries:
            met = F.coalesce(F.array_contains("rules", rule.kind), F.lit(False))
        else:
            met = text.rlike(f"[0-9a-f]{{{rule.least},}}") if rule.kind == "hex" else text.rlike(rule.regex)
        spans.append(F.when(met, _spans(rule, rank, text)).otherwise(none).alias(rule.kind))
    wide = joined.select("doc_id", *spans)
    base = [r.kind for r in rules if r.base]

    def listed(kinds):
        ordered = F.array_sort(F.concat(*[F.col(k) for k in kinds]))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in base]
    return wide.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed([r.kind for r in rules]).alias("spans"))


# Fixed patterns of the contract and of well-known tokens, as DuckDB reads them: kind, pattern, group, least characters.
SQL_RULES = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("private_key", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36}", 0, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 1),
)
SQL_BASE = ("assign", "access", "hex")


def oracle_sql() -> str:
    """The same spans without any index, in DuckDB."""
    parts = []
    for rank, (kind, pattern, group, _) in enumerate(SQL_RULES):
        regex = pattern.replace("'", "''")
        where = "[0-9a-f]{24}" if kind == "hex" else regex
        parts.append(
            f"""SELECT rowid_, {rank} AS rank, '{kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
                 's': list_sum(list_transform(gaps[1:i], lambda x: len(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0)::BIGINT,
                 'n': len(m[i]), 'g': len(g[i])}})) AS x
               FROM (SELECT rowid_, regexp_extract_all(text, '{regex}', 0) AS m, regexp_extract_all(text, '{regex}', {group}) AS g, regexp_split_to_array(text, '{regex}') AS gaps
                     FROM d WHERE regexp_matches(text, '{where}'))"""
        )
    least = " ".join(f"WHEN '{kind}' THEN {n}" for kind, _, _, n in SQL_RULES)
    base = ", ".join(f"'{k}'" for k in SQL_BASE)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}')::BIGINT AS n_{k}" for k in SQL_BASE)
    line = "kind || ':' || s || ':' || e"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rowid_, doc_id, coalesce(text, '') AS text FROM documents),
a AS ({" UNION ALL ".join(parts)}),
f AS (SELECT rowid_, rank, kind, x.s AS s, x.s + x.n AS e FROM a WHERE x.g >= CASE kind {least} END),
c AS (SELECT rowid_, {counts},
        coalesce(string_agg({line}, ',' ORDER BY s, rank) FILTER (WHERE kind IN ({base})), '') AS b,
        string_agg({line}, ',' ORDER BY s, rank) AS spans
      FROM f GROUP BY rowid_)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in SQL_BASE)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN c USING (rowid_)
"""
