"""Registered queries of the training-data operators and their DuckDB twins.

Operators that SQL cannot express (hashes that DuckDB lacks, trained models, chains) have no twin; their
tests compare them with brute force.
"""

from __future__ import annotations

from . import alignment, chat, decontaminate, imatch, langid, lines, mixing, passages, pii, quality, repair, simhash, warc

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_simhash": simhash.op2_simhash,
    "op3_quality": quality.op3_quality,
    "op4_passages": passages.op4_passages,
    "op5_imatch": imatch.op5_imatch,
    "op6_chat": chat.op6_chat,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_warc": warc.op8_warc,
    "op9_lines": lines.op9_lines,
    "op10_langid": langid.op10_langid,
    "op11_pii": pii.op11_pii,
    "op12_alignment": alignment.op12_alignment,
    "op13_repair": repair.op13_repair,
}
SQL = {
    "op1_mix": mixing.OP1_SQL,
    "op6_chat": chat.OP6_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op8_warc": warc.OP8_SQL,
}
