"""Text functions for SQL: ``register(spark)`` makes them temporary functions of the session.

vs_tokens, vs_shape and vs_is_proposition are SQL bodies, so the optimiser sees through them; vs_segments is a table
function over one text: SELECT s.* FROM docs, LATERAL vs_segments(text) s.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from veristrata.functions import text as T


def _quoted(x: str) -> str:
    return "r'" + x + "'" if "'" not in x else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession) -> None:
    words = ", ".join(f"'{w}'" for w in T.FUNCTION_WORDS)
    bodies = {
        "vs_tokens(t STRING) RETURNS ARRAY<STRING>": f"filter(regexp_extract_all(lower(t), '[a-z0-9]+', 0), w -> NOT array_contains(array({words}), w))",
        "vs_strip(t STRING) RETURNS STRING": f"regexp_replace(t, {_quoted(f'^[{T.SPACE}]+|[{T.SPACE}]+$')}, '')",
        "vs_shape(t STRING) RETURNS STRING": f"vs_strip(regexp_replace(regexp_replace(lower(t), {_quoted(T.SHAPE_PUNCTUATION)}, ' '), {_quoted(f'[{T.SPACE}]+')}, ' '))",
        "vs_is_proposition(t STRING) RETURNS BOOLEAN": f"length(vs_strip(t)) >= {T.MIN_PROPOSITION} AND NOT t RLIKE {_quoted(T.CONTROL)} AND vs_strip(t) RLIKE {_quoted(chr(92) + 'p{L}')}",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    @udtf(returnType="ordinal int, start_offset int, end_offset int, text string")
    class Segments:
        def eval(self, content: str):
            from veristrata.operators.segment import spans

            for n, (a, b) in enumerate(spans(content)):
                yield n, a, b, content[a:b]

    spark.udtf.register("vs_segments", Segments)
