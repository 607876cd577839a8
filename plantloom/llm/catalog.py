"""The registered queries of this subpackage and their SQL oracles."""

from __future__ import annotations

from plantloom.llm.graph import op6_robust_graph
from plantloom.llm.lang import op10_language_mixture
from plantloom.llm.lexical import OP12_SQL, op12_lexical_search
from plantloom.llm.license import op7_license_scan
from plantloom.llm.lm import op4_ppm_scores
from plantloom.llm.mix import op2_mix_sources
from plantloom.llm.near import op3_ngram_jaccard_join
from plantloom.llm.pack import op9_best_fit_packing
from plantloom.llm.phrases import OP13_SQL, op13_collocations
from plantloom.llm.private import op11_sanitise
from plantloom.llm.shard import op1_kd_shards
from plantloom.llm.topk import OP5_SQL, op5_ball_tree_topk
from plantloom.llm.warc import op8_warc_revisits

QUERIES = {
    "op1_kd_shards": op1_kd_shards,
    "op2_mix_sources": op2_mix_sources,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_ppm_scores": op4_ppm_scores,
    "op5_ball_tree_topk": op5_ball_tree_topk,
    "op6_robust_graph": op6_robust_graph,
    "op7_license_scan": op7_license_scan,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_language_mixture": op10_language_mixture,
    "op11_sanitise": op11_sanitise,
    "op12_lexical_search": op12_lexical_search,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op5_ball_tree_topk": OP5_SQL,
    "op12_lexical_search": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
