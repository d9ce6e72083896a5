"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from lectern.llm import chat, decontam, fptree, html, lattice, lines, periodic, pieces, pii, quality, secrets, simhash, toxicity

ALL = (
    pieces.op1_pieces,
    lattice.op2_lattice,
    chat.op3_chat,
    simhash.op4_simhash,
    quality.op5_quality,
    secrets.op6_secrets,
    pii.op7_pii,
    html.op8_html,
    toxicity.op9_toxicity,
    decontam.op10_decontam,
    periodic.op11_periodic,
    lines.op12_lines,
    fptree.op13_ranked,
)


def queries() -> dict:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": chat.OP3_SQL, "op10_decontam": decontam.OP10_SQL, "op12_lines": lines.OP12_SQL, "op13_ranked": fptree.OP13_SQL}
