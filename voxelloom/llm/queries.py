"""The registered queries of the training-data operators and the SQL that tells their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontam, embed_dedup, html_wrapper, jaccard_join, license_scan, line_quality, mixing, secret_scan, spelling, token_output, toxicity, vector_codes, warc
from .common import prepare, table


def tokenizer_path(name: str = token_output.TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark, sf_dir):
    docs = table(prepare(spark), sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    held = toxicity.held_out().alias("held_out")
    predicted = (F.col("toxic_score") >= toxicity.TOXIC_FROM).cast("int").alias("predicted")
    return scored.select("doc_id", held, F.col("toxic_score").alias("score"), predicted, "toxic_words", "toxic_spans")


def op2_html_wrapper(spark, sf_dir):
    pages = table(prepare(spark), sf_dir, "pages").select("page_id", "url", "html")
    out = html_wrapper.extract(pages, html_wrapper.induce(pages))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.col("main_chars").alias("n_chars"))


def op3_token_output(spark, sf_dir):
    return token_output.token_output(table(prepare(spark), sf_dir, "documents"), tokenizer_path())


def op4_embedding_near_dedup(spark, sf_dir):
    return embed_dedup.near_duplicates(table(prepare(spark), sf_dir, "embeddings"))


def op5_warc(spark, sf_dir):
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "status")


def op6_decontamination(spark, sf_dir):
    return decontam.find_leaks(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark, sf_dir):
    return jaccard_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_links", "class_id", "kept")


def op9_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark, sf_dir):
    return vector_codes.compress(table(prepare(spark), sf_dir, "embeddings"))


def op12_line_quality(spark, sf_dir):
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    model = line_quality.fit(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return line_quality.label_lines(docs, model).drop("text")


def op13_spelling(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_html_wrapper": op2_html_wrapper,
    "op3_token_output": op3_token_output,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_warc": op5_warc,
    "op6_decontamination": op6_decontamination,
    "op7_license_scan": op7_license_scan,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_mix_sources": op9_mix_sources,
    "op10_secret_scan": op10_secret_scan,
    "op11_vector_codes": op11_vector_codes,
    "op12_line_quality": op12_line_quality,
    "op13_spelling": op13_spelling,
}

ORACLE_SQL = {
    "op9_mix_sources": mixing.ORACLE_SQL,
    "op7_license_scan": license_scan.oracle_sql(),
    "op10_secret_scan": secret_scan.oracle_sql(),
    "op11_vector_codes": vector_codes.oracle_sql(),
    "op13_spelling": spelling.oracle_sql(),
}
