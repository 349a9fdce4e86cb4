"""The queries of this subpackage by name, each over its whole table, and their SQL where SQL can state them."""

from __future__ import annotations

from tidemark.llm import bpe, codes, collocation, decontam, jaccard, kneser, language, linededup, quality, suffixes, toxicity, urlfilter, vectors

QUERIES = {
    "op1_bpe": bpe.run,
    "op2_line_dedup": linededup.run,
    "op3_toxicity": toxicity.run,
    "op4_decontamination": decontam.run,
    "op5_embedding_near_dedup": vectors.run,
    "op6_quality": quality.run,
    "op7_url_filter": urlfilter.run,
    "op8_kneser_ney": kneser.run,
    "op9_jaccard_join": jaccard.run,
    "op10_language": language.run,
    "op11_collocation": collocation.run,
    "op12_suffix_dedup": suffixes.run,
    "op13_vector_codes": codes.run,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": linededup.ORACLE_SQL,
    "op7_url_filter": urlfilter.ORACLE_SQL,
    "op11_collocation": collocation.ORACLE_SQL,
    "op13_vector_codes": codes.ORACLE_SQL,
}
