"""The queries of this package by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folium.llm import queries_mining as mining
from folium.llm import queries_models as models
from folium.llm import queries_native as native
from folium.llm import queries_search as search
from folium.llm import queries_secrets as secrets
from folium.llm import queries_text as text
from folium.llm import queries_urls as urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": urls.op1_url_filters,
        "op2_decontamination": text.op2_decontamination,
        "op3_exact_dedup": native.op3_exact_dedup,
        "op4_mixing": native.op4_mixing,
        "op5_simhash": text.op5_simhash,
        "op6_toxicity": models.op6_toxicity,
        "op7_token_counts": text.op7_token_counts,
        "op8_secret_scan": secrets.op8_secret_scan,
        "op9_license_scan": models.op9_license_scan,
        "op10_quality": models.op10_quality,
        "op11_phrases": mining.op11_phrases,
        "op12_nearest": search.op12_nearest,
        "op13_conversation_repair": mining.op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": urls.OP1_SQL, "op3_exact_dedup": native.OP3_SQL, "op4_mixing": native.OP4_SQL, "op11_phrases": mining.OP11_SQL, "op12_nearest": search.OP12_SQL, "op13_conversation_repair": mining.OP13_SQL}
