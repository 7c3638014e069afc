"""Named query plans over the given tables (Spark) and their DuckDB twins."""

from . import q_evaluate, q_knn, q_models, q_profile, q_report, q_select, q_train  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
