"""The queries of this folder's operators, over their whole tables, and SQL for those that SQL expresses.

Without SQL, and tested against brute force instead: op2 (marks from statistics of several passes), op3 (XXH64), op4 and
op10 (learned), op6, op8 and op9 (tokenizers), op13 (rates by iteration).
"""

from __future__ import annotations

from quarrylight.llm import binary, chat, decontaminate, language, mixing, nested_schema, packing, personal, quality, secrets, simhash, spelling, token_counts

QUERIES = {
    "op1_decontaminate": decontaminate.op1,
    "op2_personal_data": personal.op2,
    "op3_simhash": simhash.op3,
    "op4_quality_rules": quality.op4,
    "op5_secrets": secrets.op5,
    "op6_packing": packing.op6,
    "op7_chat": chat.op7,
    "op8_token_counts": token_counts.op8,
    "op9_token_files": binary.op9,
    "op10_language": language.op10,
    "op11_nested_schema": nested_schema.op11,
    "op12_spelling": spelling.op12,
    "op13_mixing": mixing.op13,
}
ORACLES = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op5_secrets": secrets.op5_sql(),
    "op7_chat": chat.OP7_SQL,
    "op11_nested_schema": nested_schema.OP11_SQL,
    "op12_spelling": spelling.OP12_SQL,
}
