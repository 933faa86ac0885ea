"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from smishlake.llm import byte_bpe, collocations, cross_polytope, cube_mix, host_rules, jaccard_join, language_codes, license_scan, member_lloyd, reply_trees, segment_bpe, site_templates, toxicity

QUERIES = {
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op10_site_templates": site_templates.op10_site_templates,
    "op3_cross_polytope": cross_polytope.op3_cross_polytope,
    "op5_reply_trees": reply_trees.op5_reply_trees,
    "op8_cube_mix": cube_mix.op8_cube_mix,
    "op1_toxicity": toxicity.op1_toxicity,
    "op6_language_codes": language_codes.op6_language_codes,
    "op4_host_rules": host_rules.op4_host_rules,
    "op7_license_scan": license_scan.op7_license_scan,
    "op9_byte_bpe": byte_bpe.op9_byte_bpe,
    "op11_collocations": collocations.op11_collocations,
    "op12_segment_bpe": segment_bpe.op12_segment_bpe,
    "op13_member_lloyd": member_lloyd.op13_member_lloyd,
}
ORACLES: dict[str, str] = {
    "op2_jaccard_join": jaccard_join.ORACLE,
    "op3_cross_polytope": cross_polytope.ORACLE,
    "op5_reply_trees": reply_trees.ORACLE,
    "op4_host_rules": host_rules.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op13_member_lloyd": member_lloyd.ORACLE,
}
