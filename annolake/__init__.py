"""annolake: check and standardize document annotations with Spark.

Everything takes and returns DataFrames or Columns.  Rows are keyed by
``(study_id, doc_id, page, annot_idx)``; ``page`` is 1-based everywhere and
sinks subtract where a format counts from 0.
"""
