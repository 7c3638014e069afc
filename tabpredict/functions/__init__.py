"""Scalar column expressions (all JVM-side built-ins)."""

from .expr import (  # noqa: F401
    binarize,
    clip_prob,
    flag,
    hash32,
    inverse_log,
    str_prefix,
    str_suffix,
)
