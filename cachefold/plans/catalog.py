"""All registered queries: importing the operator modules registers them."""

from __future__ import annotations

from cachefold.operators import blocks, cosched, identity, index, planner, prefix, store, telemetry, tiers  # noqa: F401
from cachefold.plans.registry import ORACLES, QUERIES  # noqa: F401
from cachefold.sources import logs  # noqa: F401
from cachefold.streaming import delivery, fold  # noqa: F401
