"""SQL of rules whose state depends on the row before: one recursive step per row and stream."""

from __future__ import annotations

import re


def fold(rows: str, key: str, order: str, state: dict[str, tuple[str, str]], select: str, extra: str = "") -> str:
    """``rows`` walked in order per ``key``; ``state`` maps a name to its start value and its next one.

    A next value names the row as ``s.column`` and the state before it as ``r.name``. ``{name}`` in a later entry stands
    for the next value of an earlier one. ``select`` picks from the rows ``s`` joined to their states ``r``; ``extra`` goes
    on behind them. Names that begin with ``_`` are only shorthands and no columns.
    """
    nexts: dict[str, str] = {}
    for name, (_, step) in state.items():
        nexts[name] = "(" + re.sub(r"\{(\w+)\}", lambda m: nexts[m[1]], step) + ")"
    kept = [n for n in state if not n.startswith("_")]
    start = ", ".join(f"{state[n][0]} AS {n}" for n in kept)
    step = ", ".join(f"{nexts[n]} AS {n}" for n in kept)
    return f"""WITH RECURSIVE s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS k FROM ({rows}) x),
        r AS (SELECT DISTINCT {key} AS _key, 0::BIGINT AS k, {start} FROM s UNION ALL SELECT s.{key}, s.k, {step} FROM r JOIN s ON s.{key} = r._key AND s.k = r.k + 1)
        SELECT {select} FROM s JOIN r ON s.{key} = r._key AND s.k = r.k {extra}"""
