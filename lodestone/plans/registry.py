"""Every query of the retrieval engine by name, with its SQL oracle."""

from __future__ import annotations

from lodestone.plans import corpus, graphs, search
from lodestone.plans.base import ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "corpus", "graphs", "search"]

FLAGSHIP = "strategy_08_rrf_dedup_mmr"
