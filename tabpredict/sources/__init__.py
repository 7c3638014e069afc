"""Sources and sinks: parquet tables, CSV, derived observation tables,
model persistence."""

from .models import load_model, save_model  # noqa: F401
from .tables import (  # noqa: F401
    CHURN_FEATURES,
    LINE_FEATURES,
    churn_obs,
    embeddings_obs,
    line_obs,
    raw_obs,
    read_csv,
    read_table,
    scored_obs,
)
