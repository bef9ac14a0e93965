"""The subpackage's queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, license_scan, merkle, quality_rules, substring_dedup
from .class_lm import op6_class_lm
from .collocations import op11_collocations
from .license_scan import op12_license_scan
from .merkle import op13_merkle_manifest
from .mixing import op10_mixing
from .neighbours import op4_neighbours
from .ngram_join import op3_ngram_join
from .packing import op8_packing
from .quality_rules import op1_quality_rules
from .secret_scan import op7_secret_scan
from .resharding import op5_resharding
from .substring_dedup import op9_substring_dedup
from .toxicity import op2_toxicity

QUERIES = (
    op1_quality_rules, op2_toxicity, op3_ngram_join, op4_neighbours, op5_resharding,
    op6_class_lm, op7_secret_scan, op8_packing, op9_substring_dedup, op10_mixing, op11_collocations, op12_license_scan, op13_merkle_manifest,
)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the top of the repository; only this query needs it

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules.ORACLE_SQL, "op9_substring_dedup": substring_dedup.ORACLE_SQL, "op11_collocations": collocations.ORACLE_SQL, "op12_license_scan": license_scan.ORACLE_SQL, "op13_merkle_manifest": merkle.ORACLE_SQL}
