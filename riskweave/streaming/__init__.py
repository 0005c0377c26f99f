"""Row-level rules and rolling counts on streams of transactions."""

from .rolling import daily_counts, only, rolling_counts
from .screening import screen

__all__ = ["daily_counts", "only", "rolling_counts", "screen"]
