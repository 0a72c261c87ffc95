"""The queries of this package and, where SQL can express them, their oracles."""

from __future__ import annotations

from clusterloom.llm.chat_format import OP2_SQL, op2_chat_format
from clusterloom.llm.decontam import op7_decontaminate
from clusterloom.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from clusterloom.llm.lang_id import op9_lang_id
from clusterloom.llm.mixing import OP6_SQL, op6_mixing
from clusterloom.llm.near_dedup import OP10_SQL, op10_near_dedup
from clusterloom.llm.pii import op5_pii
from clusterloom.llm.sharding import OP8_SQL, op8_sharding
from clusterloom.llm.substring_dedup import OP3_SQL, op3_substring_dedup
from clusterloom.llm.url_filters import OP1_SQL, op1_url_filters

QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_chat_format": op2_chat_format,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_pii": op5_pii,
    "op6_mixing": op6_mixing,
    "op7_decontaminate": op7_decontaminate,
    "op8_sharding": op8_sharding,
    "op9_lang_id": op9_lang_id,
    "op10_near_dedup": op10_near_dedup,
}
#: The others use checksums, models or searches that DuckDB has no words for; tests hold them against brute force.
ORACLES = {
    "op1_url_filters": OP1_SQL,
    "op2_chat_format": OP2_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op6_mixing": OP6_SQL,
    "op8_sharding": OP8_SQL,
    "op10_near_dedup": OP10_SQL,
}
