"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import centroids, decontaminate, language, line_dedup, merkle, mixing, near_vectors, ngram_join, pii, quality, secrets, suffix_dedup, toxicity

QUERIES = {
    "op1_near_vectors": near_vectors.op1_near_vectors,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_language_id": language.op4_language_id,
    "op5_pii": pii.op5_pii,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_mixing": mixing.op9_mixing,
    "op10_quality": quality.op10_quality,
    "op11_centroid_clusters": centroids.op11_centroid_clusters,
    "op12_secrets": secrets.op12_secrets,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}
ORACLE_SQL = {
    "op2_line_dedup": line_dedup.SQL,
    "op5_pii": pii.SQL,
    "op7_decontamination": decontaminate.SQL,
    "op9_mixing": mixing.SQL,
    "op11_centroid_clusters": centroids.SQL,
    "op12_secrets": secrets.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
