"""Chunks to company profiles, and search results to discovered sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.operators import discovery as D, facts as O, profiles as P
from tessera.sources import stores as R


def profiles_from_chunks(chunks: DataFrame) -> DataFrame:
    """Facts by rule from each chunk, merged per company, built into a profile.

    ``chunks`` holds (cnpj_basico, chunk_index, chunk_content, page_source array).
    """
    facts = O.bundle_facts(O.validate_facts(O.extract_facts(chunks)))
    return P.build_profile(O.merge_facts(facts, companies=chunks))


def discoveries_from_searches(requests: DataFrame, log: DataFrame, names: DataFrame) -> DataFrame:
    """Latest search of each company to a found or not-found site.

    ``log`` holds (cnpj_basico, query_used, results, created_at); ``names`` holds
    (cnpj_basico, name).
    """
    latest = R.latest_per_key(log, "cnpj_basico", "created_at", "query_used").withColumn(
        "results_count", F.size("results")
    )
    hits = D.filter_search_results(R.search_hits(latest.select("cnpj_basico", "results")))
    named = hits.join(names, "cnpj_basico")
    searches = latest.select("cnpj_basico", "results_count")
    return D.discovery_rows(requests, searches, hits, D.match_site(named))
