"""Dataset profiling, file SQL, trends, redaction and log tables on Spark."""

from tabscope.plans.profile import compact_profile, inspect_dataset, profile_dataset, profile_frame
from tabscope.plans.sql import SqlResult, open_workspace, run_sql
from tabscope.plans.trend import dataset_trend, frame_trend
from tabscope.session import local_session, scratch_path

__all__ = [
    "SqlResult",
    "compact_profile",
    "dataset_trend",
    "frame_trend",
    "inspect_dataset",
    "local_session",
    "open_workspace",
    "profile_dataset",
    "profile_frame",
    "run_sql",
    "scratch_path",
]
