"""coheral: text-coherence and LLM-evaluation analytics as Spark DataFrame operators.

Layout
------
sources/    table scans, file readers, sinks and the derived test fixtures
functions/  Column-expression builders (strings, arrays, math, hashing)
operators/  DataFrame -> DataFrame operators grouped by domain
plans/      registered queries (query name -> Spark job) and their SQL oracles
streaming/  Structured Streaming variants of the live monitor
"""

__version__ = "0.1.0"
