"""The corpus pipeline: documents through quality rules, near duplicates, secrets, mixing and packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; the last gives pieces of
token sequences. run() writes each stage's result to the shared folder and reads it again.

Defined results: stages take documents with the columns doc_id, text, lang, source and n_chars, each of which may be null, and
ignore others; repeated rows become one at the second stage, as do copies without id; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tensorjobs.llm import mixing, ngram_join, packing, quality_rules, secret_scan
from tensorjobs.llm.common import cut, table

STAGES = [
    ("quality rules", quality_rules.stage),
    ("n-gram Jaccard join", ngram_join.stage),
    ("secret scans", secret_scan.stage),
    ("mixing to target weights", mixing.stage),
    ("packing", packing.stage),
]

#: The forest, the raking and the tokenizer are beyond SQL; tests compare the first, second and fifth with brute force and check the others on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
