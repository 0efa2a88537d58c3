"""The registered queries of the training-data operators, with their SQL where
SQL can say what they do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import ann, chat, langid, lm, mixing, packing, sharding, simhash, topk, toxicity
from gristmill.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(table(spark, sf_dir, name))


def queries() -> dict[str, Query]:
    return {
        "op1_sharding": _over("documents", sharding.sharding_query),
        "op2_simhash": _over("documents", simhash.near_duplicates),
        "op3_topk": _over("embeddings", topk.topk_query),
        "op4_langid": _over("documents", langid.langid_query),
        "op5_chat": _over("conversations", chat.chat_query),
        "op6_mixing": _over("documents", mixing.mix_query),
        "op7_toxicity": lambda spark, d: toxicity.toxicity_query(table(spark, d, "documents"), table(spark, d, "labels")),
        "op8_ann": _over("embeddings", ann.ann_query),
        "op9_packing": _over("documents", packing.packing_query),
        "op10_lm": _over("documents", lm.lm_query),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": sharding.SHARDING_SQL, "op3_topk": topk.TOPK_SQL, "op5_chat": chat.CHAT_SQL, "op6_mixing": mixing.MIX_SQL}
