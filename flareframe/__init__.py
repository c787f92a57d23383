"""Spark-native preparation and verification of event-forecast datasets.

Every operator takes DataFrames and returns a DataFrame.  Most are lazy; those that need a small result
first (``downsample``, ``keep_plan``, ``stratified_split``, ``exact_median``, ``fit_scaler``,
``summary_metrics``, ``multilabel_metrics``, ``check_exclusive``, ``require_groups``) run jobs while the
plan is built.  Every function in
``flareframe.functions`` takes columns and returns a column.
"""

from flareframe.session import get_session, prepare

__all__ = ["get_session", "prepare"]
