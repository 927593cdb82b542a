"""Table layouts shared by sources, operators and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

RECT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x0", "y0", "x1", "y1")])
RGB = T.StructType([T.StructField(n, T.DoubleType()) for n in ("r", "g", "b")])

# Who an annotation is; carried through every operator.
ANNOTATION_KEY = ("study_id", "doc_id", "page", "annot_idx")
# Which document it stands in: names of documents repeat across studies.
DOCUMENT_KEY = ("study_id", "doc_id")


def document_key(*tables: DataFrame) -> list[str]:
    """The document key's columns that all tables have; tables of one study may lack it."""
    return [c for c in DOCUMENT_KEY if all(c in t.columns for t in tables)]

ANNOTATIONS = T.StructType([
    T.StructField("study_id", T.StringType()),
    T.StructField("doc_id", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("annot_idx", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("rect", RECT),
    T.StructField("da", T.StringType()),
    T.StructField("appearance_text", T.StringType()),
    T.StructField("fill", RGB),
    T.StructField("stroke", RGB),
    T.StructField("page_height", T.DoubleType()),
])

DATASET_CATALOG = "domain string, label string, path string"
VARIABLE_CATALOG = ("domain string, ordinal int, name string, type string, length int, "
                    "label string, format string, informat string")
SUPP_VALUES = "domain string, qnam string"
RELREC_VALUES = "idvar string"

AUDIT_EVENTS = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("user", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("details", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("ip_address", T.StringType()),
])

# Fields a pattern may fill, in output order.
PARSED_FIELDS = ("domain", "variable_name", "value", "condition", "label",
                 "test_cd_variable", "test_cd_value", "variable_name_end")

SEVERITIES = ("ERROR", "WARNING", "INFO")
CATEGORIES = (
    "Missing Variable", "Wrong Domain", "Typo in Variable Name", "Format Mismatch",
    "Missing Value in Column", "Incorrect Value", "Mismatched Domain",
    "Metadata Mismatch", "Pattern Match",
)
