"""Registered queries of the operators, each with production parameters over its whole table, beside the SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millwatch.llm import bpe, exact, jaccard, langid, linkgraph, lm, mixing, periods, resharding, suffix, toxicity, variants, vptree
from millwatch.llm.tables import table
from millwatch.session import ship_package


def _over(name: str, build: Callable[..., DataFrame], *more: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query that applies an operator to whole tables."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return build(*(table(spark, folder, t) for t in (name, *more)))

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": _over("documents", lambda docs: bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))),
    "op2_lm_score": _over("documents", lm.score_texts),
    "op3_exact_dedup": _over("documents", exact.exact_groups),
    "op4_nearest": _over("embeddings", vptree.nearest),
    "op5_toxicity": _over("documents", toxicity.toxicity, "labels"),
    "op6_suffix_dedup": _over("documents", suffix.remove_repeats),
    "op7_language": _over("documents", langid.identify),
    "op8_jaccard_join": _over("documents", jaccard.similar_documents),
    "op9_url_filter": _over("pages", linkgraph.judge_pages),
    "op10_mixing": _over("documents", mixing.mixed_sizes),
    "op11_periodic_runs": _over("documents", periods.run_digests),
    "op12_reshard": _over("documents", resharding.even_shards),
    "op13_spelling_variants": _over("documents", variants.document_variants),
}
ORACLES: dict[str, str] = {"op3_exact_dedup": exact.SQL, "op4_nearest": vptree.SQL, "op9_url_filter": linkgraph.sql()}
