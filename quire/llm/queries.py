"""The registered queries of this subpackage and the SQL that states the same, where SQL can."""

from quire.llm.byte_bpe import op10_byte_bpe
from quire.llm.chat_format import OP8_SQL, op8_chat_format
from quire.llm.html_text import op1_html_text
from quire.llm.line_dedup import OP4_SQL, op4_line_dedup
from quire.llm.media import op9_media_columns
from quire.llm.mixing import OP6_SQL, op6_mixing
from quire.llm.quality import OP2_SQL, op2_quality_rules
from quire.llm.sharding import op7_sharding
from quire.llm.simhash import op3_simhash
from quire.llm.toxicity import op5_toxicity

QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_quality_rules": op2_quality_rules,
    "op3_simhash": op3_simhash,
    "op4_line_dedup": op4_line_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing,
    "op7_sharding": op7_sharding,
    "op8_chat_format": op8_chat_format,
    "op9_media_columns": op9_media_columns,
    "op10_byte_bpe": op10_byte_bpe,
}

#: The others are tested against brute force, round trips or held-out labels in tests/llm.
ORACLES = {
    "op2_quality_rules": OP2_SQL,
    "op4_line_dedup": OP4_SQL,
    "op6_mixing": OP6_SQL,
    "op8_chat_format": OP8_SQL,
}
