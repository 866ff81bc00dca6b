"""lodestone: a PySpark engine that decides which rows of a wide table to label next.

Sub-packages: ``sources`` (loading and row identity), ``functions`` (column expressions),
``operators`` (hygiene, statistics, vectors, clustering, acquisition), ``plans`` (whole
workflows and the registered queries) and ``streaming`` (rounds over an append-only source).
"""

__version__ = "0.1.0"
