"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from .chat_prefix import OP7_SQL, op7_chat_prefix
from .decontamination import op4_decontamination
from .license_scan import op1_license_scan
from .line_dedup import op2_line_dedup
from .lm_score import op9_lm_score
from .near_dedup import op8_near_dedup
from .packing import op10_packing
from .quality_classifier import op6_quality_classifier
from .quality_rules import OP3_SQL, op3_quality_rules
from .warc import OP5_SQL, op5_warc_segments

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_decontamination": op4_decontamination,
    "op5_warc_segments": op5_warc_segments,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_chat_prefix": op7_chat_prefix,
    "op8_near_dedup": op8_near_dedup,
    "op9_lm_score": op9_lm_score,
    "op10_packing": op10_packing,
}

ORACLE_SQL = {
    "op3_quality_rules": OP3_SQL,
    "op5_warc_segments": OP5_SQL,
    "op7_chat_prefix": OP7_SQL,
}
