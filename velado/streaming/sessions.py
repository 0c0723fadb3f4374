"""Streaming chat sessions: markers that stay the same across micro-batches, in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .python_rules import Session

KINDS = ("EMAIL", "TELEFONE", "CPF", "RG")
OUT = "scope_id string, seq long, text string"


class Known(dict):
    """A scope's markers, fetched from the state one by one as a batch asks for them."""

    def __init__(self, state):
        super().__init__()
        self.state, self.missing = state, set()

    def __contains__(self, key) -> bool:
        if not super().__contains__(key):
            if key in self.missing:
                return False
            if not self.state.containsKey(key):
                self.missing.add(key)
                return False
            self[key] = tuple(self.state.getValue(key))
        return True


class Anonymizer(StatefulProcessor):
    """A map a scope, type and key -> marker and first spelling, and how many there have been of each type. A batch reads the
    values that its rows hold, however many the scope has. Rows of a batch are taken in the order of seq.

    ttl_ms: a value that has not been new for so long is forgotten, and gets another marker if it returns; numbers are never
    given twice. None keeps all.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("markers", "type string, key string", "marker string, value string", self.ttl_ms)
        self.counts = handle.getValueState("counts", ", ".join(f"{k} long" for k in KINDS))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        parts = [p for p in rows if len(p)]
        if not parts:
            return
        session = Session(Known(self.state), dict(zip(KINDS, self.counts.get(), strict=True)) if self.counts.exists() else {})
        batch = pd.concat(parts).sort_values("seq", kind="stable")
        texts = [session.anonymize(t) for t in batch["text"]]
        for k in session.new:
            self.state.updateValue(k, session.known[k])
        if session.new:
            self.counts.update(tuple(session.n.get(k, 0) for k in KINDS))
        yield pd.DataFrame({"scope_id": batch["scope_id"], "seq": batch["seq"], "text": texts})

    def close(self) -> None:
        pass


def anonymize_stream(calls: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """calls: a stream of (scope_id string, seq long, text string). Needs the RocksDB state store.

    With a time to live a query also runs batches without data, so availableNow does not end it; use a time trigger, or once."""
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return calls.groupBy("scope_id").transformWithStateInPandas(statefulProcessor=Anonymizer(ttl_ms), outputStructType=OUT, outputMode="Append", timeMode=mode)
