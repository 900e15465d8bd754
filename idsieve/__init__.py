"""idsieve: bulk screening of identity documents with PySpark.

Documents, OCR boxes, fields, image measurements, embeddings, frames, cases and
audit events are DataFrames (or streams); every evidence step is a
DataFrame -> DataFrame transform keyed by ``doc_id``.
"""

__version__ = "0.1.0"
