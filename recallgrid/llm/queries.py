"""Queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .alignment import op13_align_tokens
from .chat_format import op9_chat_format
from .decontaminate import op4_decontaminate
from .extraction import op12_main_text
from .licenses import OP7_SQL, op7_license_scan
from .mixing import OP8_SQL, op8_mix_sources
from .nearest import OP2_SQL, op2_nearest
from .quality import op10_quality
from .repetitions import op11_periodic_runs
from .simhash import op3_simhash
from .substrings import op5_substrings
from .token_counts import op6_token_counts
from .token_output import op1_token_output

QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_nearest": op2_nearest,
    "op3_simhash": op3_simhash,
    "op4_decontaminate": op4_decontaminate,
    "op5_substrings": op5_substrings,
    "op6_token_counts": op6_token_counts,
    "op7_license_scan": op7_license_scan,
    "op8_mix_sources": op8_mix_sources,
    "op9_chat_format": op9_chat_format,
    "op10_quality": op10_quality,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_main_text": op12_main_text,
    "op13_align_tokens": op13_align_tokens,
}

ORACLE_SQL = {
    "op2_nearest": OP2_SQL,
    "op7_license_scan": OP7_SQL,
    "op8_mix_sources": OP8_SQL,
    "op9_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
        sized AS (
            SELECT *, length(role) + length(text) + length('<|im_start|>') + 1 + length('<|im_end|>') + 1
                + CASE WHEN contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR regexp_matches(text, '<\\+\|')
                       THEN len(regexp_extract_all(text, '<\\*\|')) ELSE 0 END AS n_chars
            FROM turns)
        SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(n_chars) AS BIGINT) AS formatted_chars
        FROM sized GROUP BY conv_id""",
}
