"""Queries opN_<name> of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from tessella.llm import ann, bpe, chat, decontaminate, html_text, license_scan, near_dedup, quality, toxicity, warc
from tessella.session import table


def op5_html_text(spark, sf_dir):
    return html_text.digest(table(spark, sf_dir, "pages"))


def op6_license_scan(spark, sf_dir):
    return license_scan.digest(table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc(spark, sf_dir):
    return warc.digest(table(spark, sf_dir, "pages"))


def op10_ann(spark, sf_dir):
    return ann.digest(table(spark, sf_dir, "embeddings"))


def op9_decontaminate(spark, sf_dir):
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_quality(spark, sf_dir):
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe(spark, sf_dir):
    ranks, pattern = public_vocabulary()
    return bpe.digest(table(spark, sf_dir, "documents"), ranks, pattern)


def public_vocabulary():
    """Ranks and split pattern of the public byte-level vocabulary."""
    import public_tokenizers

    return bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op3_chat(spark, sf_dir):
    return chat.digest(table(spark, sf_dir, "conversations"))


def op4_near_dedup(spark, sf_dir):
    return near_dedup.digest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_bpe": op2_bpe,
    "op3_chat": op3_chat,
    "op4_near_dedup": op4_near_dedup,
    "op5_html_text": op5_html_text,
    "op6_license_scan": op6_license_scan,
    "op7_toxicity": op7_toxicity,
    "op8_warc": op8_warc,
    "op9_decontaminate": op9_decontaminate,
    "op10_ann": op10_ann,
}
ORACLES = {
    "op8_warc": warc.ORACLE_SQL,
    "op3_chat": chat.ORACLE_SQL,
    "op4_near_dedup": near_dedup.ORACLE_SQL,
    "op9_decontaminate": decontaminate.ORACLE_SQL,
}
