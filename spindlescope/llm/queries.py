"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from spindlescope.llm import (decontaminate, fuzzy_lines, minhash, mixing, page_text, periodic, quality, sampled_pieces, suffix_dedup, toxicity, url_filter, warc,
                               whitening)

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_main_text": page_text.op3_main_text,
    "op4_minhash_near_dedup": minhash.op4_minhash_near_dedup,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_spaced_seed_decontamination": decontaminate.op6_spaced_seed_decontamination,
    "op7_fuzzy_line_dedup": fuzzy_lines.op7_fuzzy_line_dedup,
    "op8_sampled_segmentations": sampled_pieces.op8_sampled_segmentations,
    "op9_warc": warc.op9_warc,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_source_mix": mixing.op12_source_mix,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}

ORACLES = {
    "op4_minhash_near_dedup": minhash.SQL,
    "op5_url_filter": url_filter.SQL,
    "op9_warc": warc.SQL,
    "op12_source_mix": mixing.SQL,
}
