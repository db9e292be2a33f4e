"""shirabe: ontology-aware text curation, matching and evaluation on PySpark.

Every operator is a function ``DataFrame -> DataFrame``.  Sub-packages:

* ``functions``  column expressions (text cleaning, JSON repair, chat rendering)
* ``operators``  relational, vector, graph, span and evaluation operators
* ``sources``    readers and writers (CSV, JSONL, OBO, NPY, XLSX)
* ``plans``      whole pipelines and the registered queries
* ``streaming``  Structured Streaming wrappers
"""

__version__ = "0.1.0"
