"""Schemas of the tables, and the values their columns allow."""

from __future__ import annotations

from pyspark.sql import types as T

_D = "id int, file_name string, full_path string, relative_path string, file_type string, total_pages int, status string, styling_metadata string, created_at timestamp_ntz, updated_at timestamp_ntz"
_P = "id int, document_id int, page_number int, original_content string, ar_content string, en_content string, fr_content string, embedding array<float>, ocr_model string, ocr_confidence float, created_at timestamp_ntz"
_T = "id int, document_id int, term string, frequency int, translation_ar string, translation_en string, translation_fr string, context string, embedding array<float>, approved boolean"
_S = "id int, run_id string, document_id int, stage string, sub_stage string, status string, progress_percent float, items_total int, items_completed int, last_successful_item string, retry_count int, error_type string, error_message string, error_traceback string, started_at timestamp_ntz, updated_at timestamp_ntz, completed_at timestamp_ntz, metadata string"
_L = "id int, run_id string, document_id int, stage string, level string, message string, context string, created_at timestamp_ntz"
_M = "id int, namespace string, key string, value string, embedding array<float>, created_at timestamp_ntz, updated_at timestamp_ntz"

_KINDS: dict[str, T.DataType] = {"int": T.IntegerType(), "string": T.StringType(), "float": T.FloatType(), "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType(), "array<float>": T.ArrayType(T.FloatType())}


def _schema(columns: str) -> T.StructType:
    """A schema without a session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in columns.split(", "))])


TABLES: dict[str, T.StructType] = {name: _schema(columns) for name, columns in (("doc_catalog", _D), ("pages", _P), ("terminology", _T), ("processing_state", _S), ("processing_log", _L), ("memory_store", _M))}

STAGES = ["scan", "ocr", "terminology_extract", "terminology_translate", "page_translate", "export"]
STATUSES = ["pending", "in_progress", "completed", "failed", "retrying", "paused"]
LANGUAGES = ["ar", "en", "fr"]


def language_column(prefix_or_suffix: str, lang: str) -> str:
    """The column of a language, for instance ``en_content`` or ``translation_en``."""
    if lang not in LANGUAGES:
        raise ValueError(f"unsupported language: {lang}")
    return f"{lang}_content" if prefix_or_suffix == "content" else f"translation_{lang}"
