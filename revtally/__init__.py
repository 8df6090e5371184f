"""Source-code history analytics on Spark: who changed how many lines of what, and when."""

from revtally.operators.history import History
from revtally.plans.stats import Stats, stats
from revtally.session import build_session

__all__ = ["History", "Stats", "build_session", "stats"]
