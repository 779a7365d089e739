"""Evidence tiers, shared by claims and records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Evidence tiers from weak to strong.
EVIDENCE_TIERS = ("deterministic_contract", "simulated_provider", "live_source_acquisition", "live_provider", "integration_runtime", "production")


def rank(tier: Column) -> Column:
    """Place of an evidence tier from 0 on, null for an unknown one."""
    return F.nullif(F.array_position(F.array(*[F.lit(t) for t in EVIDENCE_TIERS]), tier) - 1, F.lit(-1))
