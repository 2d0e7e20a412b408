"""Audit of text corpora on Spark, and the operators of a training-data pipeline (:mod:`corpuscope.llm`)."""

__version__ = "0.2.0"
