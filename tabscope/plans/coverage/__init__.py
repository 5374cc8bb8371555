"""The registered queries: every operator over whole test tables, with oracle SQL."""

from tabscope.plans.coverage.registry import ORACLES, QUERIES  # noqa: F401
from tabscope.plans.coverage import logs, profile, sources, sql, text, trend  # noqa: F401,E402
