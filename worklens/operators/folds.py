"""Folds whose next step needs the last one: by key, in order, as pandas groups."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame

GENESIS = "sha256:" + "0" * 64


def reseal(records: DataFrame) -> DataFrame:
    """(ledger_id, seq, body) to hash-linked lines, ledgers side by side. body is a JSON object without hashes."""

    def seal(rows: pd.DataFrame) -> pd.DataFrame:
        before, out = GENESIS, []
        for n, r in enumerate(rows.sort_values("seq").itertuples(), 1):
            line = json.dumps(json.loads(r.body) | {"seq": r.seq, "prevHash": before, "hash": ""}, separators=(",", ":"))
            before = "sha256:" + hashlib.sha256(line.encode()).hexdigest()
            out.append((r.ledger_id, n, line[:-3] + f'"{before}"}}'))
        return pd.DataFrame(out, columns=["ledger_id", "line", "raw"])

    return records.groupBy("ledger_id").applyInPandas(seal, "ledger_id long, line long, raw string")


def pressure_levels(samples: DataFrame, high: float, low: float) -> DataFrame:
    """(store, n, used) with the level, which rises at `high` and falls only at `low`, and its episode."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows, level, episode, levels, episodes = rows.sort_values("n"), "ok", 0, [], []
        for used in rows["used"]:
            now = "high" if used >= high or (level == "high" and used > low) else "ok"
            episode += now == "high" and level == "ok"
            level = now
            levels.append(level)
            episodes.append(episode)
        return rows.assign(level=levels, episode=episodes)

    return samples.groupBy("store").applyInPandas(fold, "store long, n long, used double, level string, episode long")
