"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from tracewright.llm import chat, containment, decision_list, hyperlang, mixing, phrases, planefile, resampling, simhash, spans, toxicity, transducer, urlmodel

QUERIES = {
    "op1_token_transducer": transducer.op1_token_transducer,
    "op2_poisson_mixture": mixing.op2_poisson_mixture,
    "op3_containment": containment.op3_containment,
    "op4_simhash_bk_tree": simhash.op4_simhash_bk_tree,
    "op5_classifier_chain": toxicity.op5_classifier_chain,
    "op6_sentence_spans": spans.op6_sentence_spans,
    "op7_typed_parts": chat.op7_typed_parts,
    "op8_bit_plane_files": planefile.op8_bit_plane_files,
    "op9_hyperdimensional": hyperlang.op9_hyperdimensional,
    "op10_decision_list": decision_list.op10_decision_list,
    "op11_byte_automaton": resampling.op11_byte_automaton,
    "op12_suffix_sigma": phrases.op12_suffix_sigma,
    "op13_url_markov": urlmodel.op13_url_markov,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op2_poisson_mixture": mixing.OP2_SQL,
    "op3_containment": containment.OP3_SQL,
    "op7_typed_parts": chat.OP7_SQL,
    "op11_byte_automaton": resampling.OP11_SQL,
    "op12_suffix_sigma": phrases.OP12_SQL,
}
