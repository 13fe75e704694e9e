"""Colloquy: DataFrame operators for conversations, labels, documents and time series on Spark.

Layers: ``functions`` (Column expressions), ``operators`` (DataFrame to DataFrame),
``sources`` (readers and writers), ``streaming`` (stateful operators), ``plans``
(registered queries and their SQL) and ``llm`` (training-data operators, which
nothing else here imports).
"""
