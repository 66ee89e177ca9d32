"""The registered queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from curalis.llm import attribution, chosen_path, language, mixing, packing, periodic, quality, quantised, secrets, spelling, suffix_dedup, toxicity, url_filters

QUERIES = {
    "op7_toxicity": toxicity.op7_toxicity,
    "op4_language": language.op4_language,
    "op3_near_vectors": quantised.op3_near_vectors,
    "op2_jaccard_join": chosen_path.op2_jaccard_join,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op1_quality": quality.op1_quality,
    "op6_section_tokens": attribution.op6_section_tokens,
    "op5_pack": packing.op5_pack,
    "op8_url_filters": url_filters.op8_url_filters,
    "op9_poisson_mix": mixing.op9_poisson_mix,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_secret_scan": secrets.op13_secret_scan,
}
SQL = {
    "op8_url_filters": url_filters.OP8_SQL,
    "op9_poisson_mix": mixing.OP9_SQL,
    "op11_periodic_runs": periodic.OP11_SQL,
    "op12_spelling_variants": spelling.OP12_SQL,
    "op13_secret_scan": secrets.OP13_SQL,
}


def queries() -> dict:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
