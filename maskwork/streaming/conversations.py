"""Placeholders that stay the same over the turns of a conversation.

Detection is stateless. Numbering keeps, per conversation, the mappings so far: earlier turns
are never renumbered, and a late turn gets the next numbers. The same function runs over streams
(keyed state) and over tables (one group per conversation).
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.engine import Document, detect
from ..operators.ledger import Ledger, anonymise

OUT = "conv_id long, turn long, role string, text string, mappings string"
STATE = "mappings string"


def _turns(rows: pd.DataFrame, ledger: Ledger) -> pd.DataFrame:
    out = []
    for r in rows.sort_values("turn", kind="stable").itertuples():
        known = len(ledger.entries)
        doc = Document(r.text or "")
        text, _ = anonymise(doc.text, doc.read([dict(s) if isinstance(s, dict) else s.asDict() for s in (r.spans if r.spans is not None else ())]), ledger)
        out.append((r.conv_id, r.turn, r.role, text, json.dumps(ledger.mappings()[known:], ensure_ascii=False)))
    return pd.DataFrame(out, columns=["conv_id", "turn", "role", "text", "mappings"])


def _loaded(state: str | None) -> Ledger:
    return Ledger().load((m["original"], m["placeholder"], m["type"]) for m in json.loads(state or "[]"))


def _with_state(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState, keep_ms: int | None = None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    ledger = _loaded(state.get[0] if state.exists else None)
    frames = list(frames)
    if frames:
        out = _turns(pd.concat(frames), ledger)
        state.update((json.dumps(ledger.mappings(), ensure_ascii=False),))
        if keep_ms is not None:
            state.setTimeoutDuration(keep_ms)
        yield out


def anonymize_stream(turns: DataFrame, keep_ms: int | None = None, **detect_options) -> DataFrame:
    """A stream of (conv_id, turn, role, text), anonymized; `mappings` holds what each turn added.

    With keep_ms, a conversation without a turn for so many milliseconds is forgotten, and would
    start anew; without it, every mapping is kept for ever.
    """
    found = detect(turns.select("conv_id", "turn", "role", "text"), **detect_options)
    timeout = GroupStateTimeout.NoTimeout if keep_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return found.groupBy("conv_id").applyInPandasWithState(partial(_with_state, keep_ms=keep_ms), OUT, STATE, "append", timeout)


def anonymize_table(turns: DataFrame, **detect_options) -> DataFrame:
    """The same over a table."""
    found = detect(turns.select("conv_id", "turn", "role", "text"), **detect_options)
    return found.groupBy("conv_id").applyInPandas(lambda rows: _turns(rows, Ledger()), OUT)
