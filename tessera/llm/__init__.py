"""Operators of a training-data pipeline. Nothing else in the library imports this package.

``queries()`` and ``oracle_sql()`` are collected here from the ``opN_*`` modules.
"""

from __future__ import annotations

from . import (
    op1_secrets,
    op2_neardup,
    op3_decontam,
    op4_html,
    op5_simple8b,
    op6_quality,
    op7_chat,
    op8_bpe,
    op9_topk,
    op10_shards,
)

MODULES = (
    op1_secrets,
    op2_neardup,
    op3_decontam,
    op4_html,
    op5_simple8b,
    op6_quality,
    op7_chat,
    op8_bpe,
    op9_topk,
    op10_shards,
)


def queries() -> dict:
    return {m.NAME: m.query for m in MODULES}


def oracle_sql() -> dict:
    return {m.NAME: m.ORACLE_SQL for m in MODULES if m.ORACLE_SQL}
