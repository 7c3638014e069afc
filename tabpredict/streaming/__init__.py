"""Streaming.

The pipeline this package rebuilds reads one table once and has no
stream, watermark, window over time or state, so nothing lives here.
Fitted models are plain ``pyspark.ml`` models or column expressions and
can be applied to a streaming DataFrame's ``transform`` unchanged.
"""
