"""All named queries of the core library."""

from __future__ import annotations

import tendril.plans.archive  # noqa: F401
import tendril.plans.linking  # noqa: F401
import tendril.plans.market  # noqa: F401
import tendril.plans.problems  # noqa: F401
import tendril.plans.registers  # noqa: F401
import tendril.plans.texts  # noqa: F401
from tendril.catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
