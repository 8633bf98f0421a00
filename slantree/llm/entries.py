"""Queries of the training-data operators over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slantree.llm import bpe_trie, filter_audit, hard_negatives, language_id, license_scan, line_dedup, mpeg_audio, near_dedup, packing, quality_classifier, quality_rules, toxicity, url_filter
from slantree.llm.language_id import held_out


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file; every executor must have it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality_classifier.learn(docs.where(~held_out()), labels.where(~held_out()))
    return quality_classifier.classify(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_links(docs).select("doc_id", "n_lines", "n_removed", "n_links", "class_docs", "removed_lines")


def op3_language_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = language_id.learn(docs.where(~held_out()))
    return language_id.identify(docs.select("doc_id", "text"), filters).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: The corpus has no file names: a document's path is its source, two levels of folders by doc_id, and a name; one in ten is a licence file.
PATH_SQL = """'/' || coalesce(source, '_') || '/' || cast(doc_id {div} 4000 as {text}) || '/' || cast(doc_id {div} 400 as {text}) || '/'
 || case when (doc_id {div} 20) % 10 = 0 then 'LICENSE-' || cast(doc_id as {text}) else cast(doc_id as {text}) || '.txt' end"""


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("path", F.expr(PATH_SQL.format(div="div", text="string")))
    return license_scan.scan(docs)


def op5_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_upper", "n_letters_ascii", "fail_bits")


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy rejects, and what it alone rejects, from the ledger's failure bits."""
    return quality_rules.ablations(quality_rules.ledger(quality_rules.measure(table(spark, sf_dir, "documents").select("text"))))


def op6_mpeg_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    audio = mpeg_audio.parse(mpeg_audio.carry(docs, "text"))
    payload, media = F.col("audio.payload"), F.col("media")
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("frames="), "audio.n_frames"),
        F.concat(F.lit("samples="), "audio.n_samples"),
        F.concat(F.lit("rate="), "audio.sample_rate"),
        F.concat(F.lit("kbps="), F.array_join(F.col("audio.bitrates").cast("array<string>"), "+")),
        F.concat(F.lit("crc_failed="), "audio.crc_failed"),
        F.concat(F.lit("table="), F.coalesce(F.col("audio.table_frames").cast("string"), F.lit("none"))),
        F.concat(F.lit("skipped="), "audio.skipped_bytes"),
        F.concat(F.lit("offsets="), F.sha2(F.array_join(F.col("audio.offsets").cast("array<string>"), ","), 256)),
    )
    return audio.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -32, 32)).alias("tail_crc32"),
        F.octet_length(media).cast("long").alias("media_bytes"),
        F.sha2(media, 256).alias("media_sha256"),
        feature.alias("feature"),
        F.col("audio.seconds").alias("seconds"),
        F.col("audio.n_frames").alias("n_frames"),
    )


def op7_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe_trie.decode(bpe_trie.encode(docs, path), path)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_superminhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85, size=3).select("doc_id", "n_shingles", "component_id", "kept")


def op9_url_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer("word_bpe_49k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


def op12_gru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs.where(~held_out()), labels.where(~held_out()))
    return toxicity.classify(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pu_quality, op2_line_join, op3_language_masks, op4_license_scan, op5_rule_ledger, rule_ablations, op6_mpeg_frames, op7_trie_bpe, op8_superminhash_groups, op9_url_automaton, op10_best_fit_packing, op11_filter_audit, op12_gru_toxicity, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    from slantree.llm import oracles

    return oracles.all_sql()
