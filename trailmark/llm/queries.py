"""The queries of this subpackage, one per operator, and the SQL some of them must equal."""

from __future__ import annotations

from trailmark.llm import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12, op13

QUERIES = {
    "op1_embedding_dedup": op1.op1_embedding_dedup,
    "op2_suffix_dedup": op2.op2_suffix_dedup,
    "op3_simhash": op3.op3_simhash,
    "op4_personal_data": op4.op4_personal_data,
    "op5_decontamination": op5.op5_decontamination,
    "op6_warc": op6.op6_warc,
    "op7_packing": op7.op7_packing,
    "op8_quality": op8.op8_quality,
    "op9_token_files": op9.op9_token_files,
    "op10_licences": op10.op10_licences,
    "op11_conversation_repair": op11.op11_conversation_repair,
    "op12_merkle_manifest": op12.op12_merkle_manifest,
    "op13_shortest_pack": op13.op13_shortest_pack,
}
ORACLE = {"op1_embedding_dedup": op1.ORACLE_SQL, "op5_decontamination": op5.ORACLE_SQL, "op6_warc": op6.ORACLE_SQL, "op12_merkle_manifest": op12.ORACLE_SQL}
