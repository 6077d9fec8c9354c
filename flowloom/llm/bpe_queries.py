"""op8: tokens of every document, and the text they decode to, as digests."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.llm.bpe import encode_documents
from flowloom.llm.registry import query, read_table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@query("op8_bpe_trie")
def bpe_trie(spark: SparkSession, sf_dir: str, path: str = VOCABULARY) -> DataFrame:
    encoded = encode_documents(read_table(spark, sf_dir, "documents"), path)
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
