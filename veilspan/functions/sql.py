"""The text functions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import text as tx

# Name: arguments, result, body. Bodies say in SQL what the Column functions say.
EXPRESSIONS = {
    "vs_pattern_view": ("v STRING", "STRING", f"translate(v, '{tx.FULL_FROM}', '{tx.FULL_TO}')"),
    "vs_sanitize_type": ("v STRING", "STRING", "CASE WHEN regexp_replace(upper(v), '[^A-Z0-9]', '') = '' THEN 'UNKNOWN' WHEN regexp_replace(upper(v), '[^A-Z0-9]', '') RLIKE '^[0-9]' THEN 'X' || regexp_replace(upper(v), '[^A-Z0-9]', '') ELSE regexp_replace(upper(v), '[^A-Z0-9]', '') END"),
    "vs_normalize": ("v STRING", "STRING", r"trim(regexp_replace(lower(v), '[\\s\\p{Z}]+', ' '))"),
    "vs_learning_key": ("kind STRING, v STRING", "STRING", "kind || '|' || lower(trim(v))"),
    "vs_text_digest": ("v STRING", "STRING", "sha2(v, 256)"),
    "vs_entity_id": ("handle STRING, kind STRING, first INT, last INT", "STRING", "substring(sha2(concat_ws('|', handle, kind, cast(first AS STRING), cast(last AS STRING)), 256), 1, 12)"),
    "vs_decode_tokens": ("v STRING", "STRING", r"regexp_replace(v, '\\{([A-Z0-9]+)\\\\_([0-9]+)\\}', '{$1_$2}')"),
    "vs_think_strip": ("v STRING", "STRING", r"trim(regexp_replace(v, '(?is)<(think|reasoning)>.*?</\\1>', ''))"),
}
ARROW = {"vs_strict_normalize": tx.strict_normalize, "vs_fold_marks": tx.fold_marks}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to spark.sql() in this session; returns their names."""
    for name, (args, kind, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    for name, udf in ARROW.items():
        spark.udf.register(name, udf)
    return [*EXPRESSIONS, *ARROW]
