"""All registered queries of the ledger library."""

from __future__ import annotations

import importlib

from worklens import plans

#: Modules of worklens.plans that register queries when imported.
MODULES = ["ledger", "chains", "summary", "proofs", "upkeep", "records", "campaigns", "runs", "captures", "accounting", "reconcile", "windows"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"worklens.plans.{name}")


def queries() -> dict[str, plans.Query]:
    _load()
    return plans.QUERIES


def oracles() -> dict[str, str]:
    _load()
    return plans.ORACLES
