"""Structured Streaming forms: plan state, jobs, rate windows, progressive totals, budget alerts and progressive searches.

Sources are folders of Parquet files. Each `run_*` processes what is there
(`availableNow`, as many batches as the source makes) and returns the result as a
DataFrame; state, results and the log lie in a folder under the shared one. With
the same `base` a later run goes on where the last one ended. Batches write to
a folder of their number, so one that runs again after a failure changes
nothing. Streams without rows give empty results. Watermarks are our own addition.
"""

from .alerts import run_budget_alerts
from .files import in_batches, read_files
from .jobs import run_jobs
from .plan import run_plan_state
from .search import run_search
from .windows import run_progress, run_rate_windows

__all__ = ["in_batches", "read_files", "run_budget_alerts", "run_jobs", "run_plan_state", "run_progress", "run_rate_windows", "run_search"]
