"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read, shared_dir


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language_id

    return language_id(read(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_dedup

    return exact_dedup(read(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import similar_groups

    return similar_groups(read(spark, sf_dir, "documents"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from .wavelet import read_ids, write_ids

    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(read(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"), end_id=2)
    return read_ids(spark.read.parquet(path))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import passage_digests

    return passage_digests(read(spark, sf_dir, "documents"))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .imatch import fingerprints

    return fingerprints(read(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import byte_digests

    return byte_digests(read(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import round_trip

    return round_trip(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefixtrie import prefix_trie

    return prefix_trie(read(spark, sf_dir, "conversations"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .manifest import tamper_check

    return tamper_check(read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in sorted(globals().items(), key=lambda x: len(x[0])) if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from . import exact, jaccard, manifest, minhash, prefixtrie, substring, suffix

    return {
        "op3_exact_dedup": exact.ORACLE_SQL, "op4_jaccard_join": jaccard.ORACLE_SQL, "op7_substring_dedup": substring.ORACLE_SQL, "op9_suffix_dedup": suffix.ORACLE_SQL,
        "op11_minhash": minhash.ORACLE_SQL, "op12_prefix_trie": prefixtrie.ORACLE_SQL, "op13_merkle": manifest.ORACLE_SQL,
    }
