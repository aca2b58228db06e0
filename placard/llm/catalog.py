"""The training-data queries and the SQL that checks them."""

from __future__ import annotations

import corpus_pipeline

from placard.llm.chat_format import OP3_SQL, op3_chat
from placard.llm.decontamination import OP7_SQL, op7_decontamination
from placard.llm.line_dedup import op9_lines
from placard.llm.mixing import OP1_SQL, op1_mixing
from placard.llm.piece_codec import op12_pieces
from placard.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from placard.llm.quality_rules import OP5_SQL, op5_quality
from placard.llm.rlz_dedup import op6_rlz
from placard.llm.secret_scan import op4_secrets
from placard.llm.simhash_dedup import op2_simhash
from placard.llm.token_files import op10_token_files
from placard.llm.turn_repair import OP13_SQL, op13_turn_repair
from placard.llm.url_filter import op8_urls

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_simhash": op2_simhash,
    "op3_chat": op3_chat,
    "op4_secrets": op4_secrets,
    "op5_quality": op5_quality,
    "op6_rlz": op6_rlz,
    "op7_decontamination": op7_decontamination,
    "op8_urls": op8_urls,
    "op9_lines": op9_lines,
    "op10_token_files": op10_token_files,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_pieces": op12_pieces,
    "op13_turn_repair": op13_turn_repair,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": OP1_SQL,
    "op3_chat": OP3_SQL,
    "op5_quality": OP5_SQL,
    "op7_decontamination": OP7_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op13_turn_repair": OP13_SQL,
}
