"""Sentiment over large text corpora, expressed as Spark DataFrame jobs.

Sub-packages: ``sources`` (landed payloads, corpus files, archives), ``functions``
(column expressions), ``operators`` (DataFrame -> DataFrame), ``plans`` (whole
jobs), ``streaming`` (the event firehose) and ``sinks`` (corpus, label and
export writers).
"""
