"""The registered queries of this subpackage: each applies one operator, with its production
parameters, to whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .oracles import ORACLES  # noqa: F401
from .shared import frugal


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return frugal(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the encoding and of what it decodes to."""
    import public_tokenizers

    from .sentencepiece_codec import encode_decode

    done = encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learned from the rows that are not held out."""
    from .language_id import identify_languages
    from .models import crc_remainder

    docs = table(spark, sf_dir, "documents")
    found = identify_languages(docs, docs.filter(crc_remainder(5) != 0))
    return found.select("doc_id", (crc_remainder(5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, items, best_lcs of every document."""
    from .decontamination import contamination_report

    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    from .pii import BASE, find_pii

    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_pii(table(spark, sf_dir, "documents")).select("doc_id", *map(count, BASE), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score, p_content, p_metadata, kept of every document."""
    from .quality_classifier import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "score", "p_content", "p_metadata", "kept")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, spans; learned from the rows that are not held out."""
    from .models import crc_remainder
    from .toxicity import score, train

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    field = train(docs, labels.filter(crc_remainder(4) != 2))
    return score(docs, field).select("doc_id", (crc_remainder(4) == 2).alias("held_out"), "score", "predicted", "spans")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, copy_of, class_id: one row per document with its group of near duplicates."""
    from .near_dedup import near_duplicate_groups

    return near_duplicate_groups(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of the words that stay."""
    from .substring_dedup import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as read back from the token files."""
    import public_tokenizers

    from .token_files import read_token_files, write_token_files

    files = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids_le").alias("ids_crc32"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rate."""
    from .quality_rules import quality_report

    return quality_report(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rate"
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of the damaged conversations."""
    from .conversation_repair import damage, repair_all

    rows = table(spark, sf_dir, "conversations")
    return repair_all(rows, damage(rows))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the damaged texts."""
    from .spelling_variants import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document with its class of linked documents."""
    from .ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_decontamination": op2_decontamination,
    "op3_language_id": op3_language_id,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_near_dedup": op5_near_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_pii": op7_pii,
    "op8_token_files": op8_token_files,
    "op9_toxicity": op9_toxicity,
    "op10_quality_rules": op10_quality_rules,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_ngram_join": op13_ngram_join,
}
