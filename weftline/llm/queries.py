"""The thin queries opN_<name>: each operator over its whole table, with the columns its contract names."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, distinct_bpe, dual_tree, hilbert_shards, host_paths, license_votes, minhash_dedup, oracles, perspectives, prefix_trie, quality_rules, substring_dedup, toxic_crf, warc


def _table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_shards(spark, sf_dir):
    return hilbert_shards.shard(_table(spark, sf_dir, "documents"))


def op2_perspectives(spark, sf_dir):
    return perspectives.rotate(_table(spark, sf_dir, "conversations"))


def op3_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), texts=False)


def op4_warc_revisits(spark, sf_dir):
    return warc.pages_through_warc(_table(spark, sf_dir, "pages"))


def op5_toxic_crf(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxic_crf.fit(docs.select("doc_id", "text"), labels, usable=~toxic_crf.held_out(F.col("doc_id")))
    scored = toxic_crf.score(docs, model, spans=False)
    return scored.select("doc_id", toxic_crf.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def tokenizer_file() -> str:
    """The byte-level BPE that the contract names; the file is not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_distinct_bpe(spark, sf_dir):
    return distinct_bpe.encode_decode(_table(spark, sf_dir, "documents"), tokenizer_file(), texts=False)


def op7_host_paths(spark, sf_dir):
    return host_paths.extract_pages(_table(spark, sf_dir, "pages"))


def op8_minhash_dedup(spark, sf_dir):
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def op10_decontaminate(spark, sf_dir):
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), texts=False)


def op11_license_votes(spark, sf_dir):
    return license_votes.scan(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


def op13_dual_tree(spark, sf_dir):
    return dual_tree.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_hilbert_shards": op1_hilbert_shards,
    "op2_perspectives": op2_perspectives,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_warc_revisits": op4_warc_revisits,
    "op5_toxic_crf": op5_toxic_crf,
    "op6_distinct_bpe": op6_distinct_bpe,
    "op7_host_paths": op7_host_paths,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_decontaminate": op10_decontaminate,
    "op11_license_votes": op11_license_votes,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_dual_tree": op13_dual_tree,
}

ORACLE_SQL: dict[str, str] = {
    "op2_perspectives": perspectives.ROTATE_SQL,
    "op3_substring_dedup": oracles.OP3,
    "op4_warc_revisits": oracles.OP4,
    "op8_minhash_dedup": oracles.OP8,
    "op9_quality_rules": oracles.OP9,
    "op10_decontaminate": oracles.OP10,
    "op11_license_votes": oracles.OP11,
    "op12_prefix_trie": oracles.OP12,
    "op13_dual_tree": oracles.OP13,
}
