"""The queries of this subpackage and their SQL, for the registry."""

from __future__ import annotations

from .bpe import op13_byte_bpe
from .chat import op8_chat_formatting
from .collocations import OP11_SQL, op11_collocations
from .decontamination import op9_decontamination
from .fim import OP12_SQL, op12_fill_in_middle
from .linededup import op6_line_dedup
from .packing import op2_packing
from .pii import op5_pii
from .quality import op1_quality_rules
from .sharding import op10_sharding
from .simhash import op4_simhash
from .toxicity import op7_toxicity
from .urls import OP3_SQL, op3_url_filters

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_packing": op2_packing,
    "op3_url_filters": op3_url_filters,
    "op4_simhash": op4_simhash,
    "op5_pii": op5_pii,
    "op6_line_dedup": op6_line_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_decontamination": op9_decontamination,
    "op10_sharding": op10_sharding,
    "op11_collocations": op11_collocations,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_byte_bpe": op13_byte_bpe,
}

SQL = {
    "op3_url_filters": OP3_SQL,
    "op11_collocations": OP11_SQL,
    "op12_fill_in_middle": OP12_SQL,
}
