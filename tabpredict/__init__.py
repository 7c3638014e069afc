"""Spark-native tabular prediction: profile, clean, split, select features,
train and evaluate classifiers over DataFrames."""

__version__ = "0.1.0"
