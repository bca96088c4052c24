"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from corpusmill.llm import decontaminate, jpeg, kmeans, licenses, lm, middle, neighbours, packing, simhash, sql, substring, token_counts, token_store, toxicity

QUERIES = {
    "op1_substring": substring.op1_substring,
    "op2_token_store": token_store.op2_token_store,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_packing": packing.op4_packing,
    "op5_lm": lm.op5_lm,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_simhash": simhash.op7_simhash,
    "op8_licenses": licenses.op8_licenses,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_media": jpeg.op10_media,
    "op11_neighbours": neighbours.op11_neighbours,
    "op12_clusters": kmeans.op12_clusters,
    "op13_middle": middle.op13_middle,
}

ORACLES: dict[str, str] = {
    "op1_substring": sql.SUBSTRING,
    "op9_decontaminate": sql.DECONTAMINATE,
    "op11_neighbours": sql.NEIGHBOURS,
    "op12_clusters": sql.clusters(),
    "op13_middle": sql.MIDDLE,
}
