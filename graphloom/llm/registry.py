"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from graphloom.llm import ann, bpe, language, license, mixing, quality, sharding, simhash, substring, voronoi

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_quality": quality.op2_quality,
    "op3_language": language.op3_language,
    "op4_mixing": mixing.op4_mixing,
    "op5_ann": ann.op5_ann,
    "op6_license": license.op6_license,
    "op7_sharding": sharding.op7_sharding,
    "op8_topk": voronoi.op8_topk,
    "op9_simhash": simhash.op9_simhash,
    "op10_substring": substring.op10_substring,
}

#: Only what SQL can express; the tests hold the others against brute force.
SQL: dict[str, str] = {"op4_mixing": mixing.OP4_SQL, "op6_license": license.OP6_SQL, "op8_topk": voronoi.OP8_SQL}
