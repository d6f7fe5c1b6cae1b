"""waymark: a pointer index, link graph and data-preparation engine on PySpark.

Everything is a DataFrame: documents, chunks, attribute keys, edges and vectors
live in ordinary tables, and every operator returns a lazy plan for Catalyst.
"""

__version__ = "0.1.0"
