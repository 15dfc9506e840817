"""The registered queries of this folder and their check SQL."""

from __future__ import annotations

from cvengine.llm import (
    collocations,
    embedding_dedup,
    hard_negatives,
    hidden_markov,
    html_text,
    line_dedup,
    neighbour_forest,
    quality,
    sentence_pieces,
    simhash_dedup,
    source_mix,
    toxicity,
    warc,
)

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_warc": warc.op3_warc,
    "op4_poisson_mix": source_mix.op4_poisson_mix,
    "op5_simhash_dedup": simhash_dedup.op5_simhash_dedup,
    "op6_quality": quality.op6_quality,
    "op7_sentence_pieces": sentence_pieces.op7_sentence_pieces,
    "op8_html_text": html_text.op8_html_text,
    "op9_nearest_neighbours": neighbour_forest.op9_nearest_neighbours,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_hidden_markov": hidden_markov.op11_hidden_markov,
    "op12_collocations": collocations.op12_collocations,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

CHECK_SQL = {
    "op3_warc": warc.CHECK_SQL,
    "op4_poisson_mix": source_mix.CHECK_SQL,
    "op10_line_dedup": line_dedup.CHECK_SQL,
    "op12_collocations": collocations.CHECK_SQL,
    "op13_hard_negatives": hard_negatives.CHECK_SQL,
}
