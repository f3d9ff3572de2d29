"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles


def tokenizer_path(name: str) -> str:
    """Where the installed package of public tokenizers has a vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import components

    return components(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import dedup

    return dedup(_table(spark, sf_dir, "documents"))


def op3_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_graph import links

    return links(_table(spark, sf_dir, "embeddings"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import token_positions

    return token_positions(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digests

    return digests(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), pattern())


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, n_items, items (ids), distances (edits of each)."""
    from .decontam import matches

    found = matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), "items", "distances"
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shards import assign

    return assign(_table(spark, sf_dir, "documents"), 16)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, score

    docs = _table(spark, sf_dir, "documents")
    return score(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import trie

    return trie(_table(spark, sf_dir, "conversations"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster

    return cluster(_table(spark, sf_dir, "embeddings"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated rules, then rules mined from the pages of labelled documents."""
    from .url_rules import Stated, judge, labelled_pages, mine, undominated

    pages = _table(spark, sf_dir, "pages")
    stated = [Stated("block", "net"), Stated("allow", "example.net", "/en/"), Stated("block", "example.com", "/de/"), Stated("allow", "org", "/fr/")]
    rules = mine(labelled_pages(pages, _table(spark, sf_dir, "labels")))
    return judge(pages, stated, undominated(rules))


def queries() -> dict:
    return {
        "op1_simhash": op1_simhash,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_embedding_graph": op3_embedding_graph,
        "op4_token_output": op4_token_output,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_warc": op6_warc,
        "op7_decontamination": op7_decontamination,
        "op8_sharding": op8_sharding,
        "op9_secret_scan": op9_secret_scan,
        "op10_quality": op10_quality,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_centroids": op12_centroids,
        "op13_url_filter": op13_url_filter,
    }


ORACLE = {
    "op6_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN f.first_id < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first_id < p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)""",
}


def oracle_sql() -> dict[str, str]:
    return ORACLE | {"op11_prefix_trie": oracles.OP11, "op12_centroids": oracles.OP12, "op13_url_filter": oracles.OP13}
