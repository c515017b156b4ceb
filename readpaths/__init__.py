"""readpaths: reading sessions, link graphs, text vectors and next-page
evaluation, written as Spark DataFrame plans.

Sub-packages:

* ``sources``   -- table scans, fixture views, session-file and page-dump readers
* ``operators`` -- filters, item map, sessions, graph, text, neighbours, evaluation
* ``functions`` -- column expressions shared by the operators
* ``plans``     -- whole jobs composed from the operators
* ``sinks``     -- parquet / text / json writers and job counters
* ``llm``       -- operators for training text (nothing else imports it)
"""

from readpaths.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]
