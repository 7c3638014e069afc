"""DataFrame operators: each takes and returns DataFrames (or small driver
models fitted by aggregates)."""
