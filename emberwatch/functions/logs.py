"""Fields of a raw log, as column expressions that stay inside the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions import fixed_values as V

# (?U): word, digit and blank classes cover all of Unicode.
_UNICODE = "(?U)"


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """Blank characters of any kind removed at both ends (``trim`` alone removes spaces only)."""
    return F.btrim(c, F.lit(V.WHITESPACE))


def lines(text: Column) -> Column:
    return F.split(text, V.LINE_BREAK)


def holds_any(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether one of ``parts`` occurs: a plain search, many times faster than a Unicode pattern that needs them."""
    return reduce(or_, [F.contains(text, F.lit(p)) for p in parts])


def is_frame(line: Column) -> Column:
    return holds_any(line, V.FRAME_PARTS) & line.rlike(_UNICODE + V.FRAME_LINE)


def exception_type(text: Column) -> Column:
    found = F.regexp_extract(text, f"{_UNICODE}({V.EXCEPTION_NAMES})", 1)
    return none_if_empty(F.when(holds_any(text, V.EXCEPTION_PARTS), found))


def stack_trace(text_lines: Column) -> Column:
    frames = F.transform(F.filter(text_lines, is_frame), strip)
    return none_if_empty(F.array_join(frames, "\n"))


def kv_pairs(text: Column) -> Column:
    """All ``key=value`` pairs in text order, as ``array<struct<key,value>>``; keys may repeat."""
    pattern = F.regexp_extract_all(text, F.lit(_UNICODE + V.KEY_VALUE), F.lit(0))
    without = F.when(text.isNotNull(), F.array().cast("array<string>"))
    found = F.when(F.contains(text, F.lit("=")), pattern).otherwise(without)
    return F.transform(
        found,
        lambda p: F.struct(
            F.substring_index(p, "=", 1).alias("key"),
            F.substr(p, F.instr(p, "=") + 1).alias("value"),
        ),
    )


def kv_last(pairs: Column, key: str) -> Column:
    """Value of the last pair with this key, else null."""
    same = F.filter(pairs, lambda p: p["key"] == key)
    return F.try_element_at(same, F.lit(-1))["value"]


def first_message(text: Column, text_lines: Column) -> Column:
    kept = F.filter(text_lines, lambda s: (strip(s) != "") & ~is_frame(s))
    return F.coalesce(
        strip(F.try_element_at(kept, F.lit(1))), F.left(text, F.lit(V.FALLBACK_CHARS))
    )


def ipv4(text: Column) -> Column:
    return none_if_empty(F.when(F.contains(text, F.lit(".")), F.regexp_extract(text, _UNICODE + V.IPV4, 0)))


def severity(text: Column) -> Column:
    found = F.when(holds_any(text, V.LEVEL_PARTS), F.regexp_extract(text, _UNICODE + V.LEVEL, 1))
    return F.coalesce(none_if_empty(found), F.lit(V.DEFAULT_LEVEL))


def parse_logs(df: DataFrame, raw_col: str = "raw_log") -> DataFrame:
    """Add the parsed fields of every log; a narrow job without shuffle or Python.

    New columns: ``exception_type, stack_trace, error_message, log_service, log_server_ip,
    log_severity, canonical_text``.
    """
    text, split_lines, pairs = F.col("_text"), F.col("_lines"), F.col("_pairs")
    message = F.col("_message")
    return (
        df.withColumn("_text", strip(F.col(raw_col)))
        .withColumns({"_lines": lines(text), "_pairs": kv_pairs(text)})
        .withColumns(
            {
                "_message": first_message(text, split_lines),
                "exception_type": exception_type(text),
                "stack_trace": stack_trace(split_lines),
                "log_service": F.coalesce(*[kv_last(pairs, k) for k in V.SERVICE_KEYS]),
                "log_server_ip": F.coalesce(
                    kv_last(pairs, "ip"), ipv4(text), kv_last(pairs, "host")
                ),
                "log_severity": severity(text),
            }
        )
        .withColumns(
            {
                "error_message": F.left(message, F.lit(V.MESSAGE_CHARS)),
                # the uncut message goes into the text that is compared
                "canonical_text": F.concat_ws(
                    " | ", F.col("exception_type"), none_if_empty(message)
                ),
            }
        )
        .drop("_text", "_lines", "_pairs", "_message")
    )
