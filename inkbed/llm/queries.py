"""The registered queries of the operators, as the contracts state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, filteraudit, jaccard, langid, mixing, nested, quality, sharding, suffixes, tokencount, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(_table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule_mask")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy does, from the ledger's bits: documents that fail it, that fail only it, and that stay without it."""
    return quality.ablation(quality.ledger(_table(spark, sf_dir, "documents")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "pieces", "first_slot", "last_slot")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    labels = _table(spark, sf_dir, "labels").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    model = toxicity.fit(docs, labels)
    return toxicity.predict(docs, model, ("doc_id", "held_out"))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(warc.write(_table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen: the conversation.  Rejected: the same up to its last assistant turn, which says what its first one said.

    There is no table of preferences, so pairs are made; those of conversations with fewer than two different assistant turns are
    marked as degenerate.
    """
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    rejected = chat.last_replaced_by_first(turns, "pair_id")
    pairs = chat.preference_pairs(turns, rejected)
    ranges = lambda c: F.array_join(F.transform(c, lambda r: F.concat_ws("-", r["from"], r["to"])), ",")
    return pairs.withColumn("chosen_loss", ranges("chosen_loss")).withColumn("rejected_loss", ranges("rejected_loss"))


def op9_tokencount(spark: SparkSession, sf_dir: str, tokenizer: str | None = None, limit: int = 1024) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    counts = tokencount.count_tokens(_table(spark, sf_dir, "documents"), tokenizer)
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = langid.fit(docs.filter(~F.col("held_out")))
    return langid.predict(docs, model, ("doc_id", "held_out"))


def op11_filteraudit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shuffled(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.clicks_schema(_table(spark, sf_dir, "clicks"))


QUERIES = {
    "op1_quality": op1_quality,
    "quality_ablation": quality_ablation,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_suffixes": op4_suffixes,
    "op5_warc": op5_warc,
    "op6_jaccard": op6_jaccard,
    "op7_decontamination": op7_decontamination,
    "op8_chat": op8_chat,
    "op9_tokencount": op9_tokencount,
    "op10_langid": op10_langid,
    "op11_filteraudit": op11_filteraudit,
    "op12_sharding": op12_sharding,
    "op13_nested": op13_nested,
}
