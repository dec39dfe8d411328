"""The opN queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, licenses, neighbours, packing, quality, shared, simhash, substrings, token_files, toxicity, urls


def _word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return neighbours.nearest(shared.table(spark, sf_dir, "embeddings"), every=20, k=20)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document."""
    return quality.quality_scores(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document without the bytes of 100-byte strings that also start earlier."""
    return substrings.digests(shared.table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document to token-id files and read the files back."""
    folder = shared.scratch_dir(spark)
    token_files.write_token_files(shared.table(spark, sf_dir, "documents"), _word_tokenizer(), folder, end_id=2)
    return token_files.read_token_files(spark, folder)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every document."""
    return toxicity.toxicity_scores(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"))


#: Fixed values of the query.
URL_RULES = [
    urls.Rule("block", "com/en/"),
    urls.Rule("allow", "example.com/en/7"),
    urls.Rule("allow", "net/de/"),
    urls.Rule("block", "example.net/de/8"),
    urls.Rule("block", "org/es/"),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every page: by rule, else by its host's trust and distrust."""
    return urls.judge(shared.table(spark, sf_dir, "pages"), URL_RULES)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles and components of links within 3 bits."""
    return simhash.near_duplicates(shared.table(spark, sf_dir, "documents"), words=3)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items contained in each document."""
    return decontaminate.contaminated(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack the tokens of all documents into sequences of at most 2048."""
    docs = shared.table(spark, sf_dir, "documents")
    pieces = shared.materialise(packing.split_documents(docs, _word_tokenizer(), end_id=0, capacity=2048, with_ids=False).drop("ids"))
    return packing.pack(pieces, capacity=2048)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    return licenses.license_labels(shared.table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neighbours": op1_neighbours,
    "op2_quality": op2_quality,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_token_files": op4_token_files,
    "op5_toxicity": op5_toxicity,
    "op6_url_filter": op6_url_filter,
    "op7_simhash": op7_simhash,
    "op8_decontamination": op8_decontamination,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_license_scan": op10_license_scan,
}

#: No entry where SQL cannot express the operator; tests/llm compares those with brute force.
ORACLE_SQL: dict[str, str] = {
    "op8_decontamination": decontaminate.ORACLE_SQL,
}
