"""weftline: Spark jobs for corpora of request/code example pairs.

Ingest and validate JSON-lines examples, build prompt datasets, search by exact
cosine similarity, run batch or streaming generation through a user-supplied
callable, score the outcome, and run parameterised analytical reports.
"""

__version__ = "0.1.0"
