"""Column expressions for log text, numeric guards and feature scaling. No Python UDFs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and words that decide the results.
BLOCK_ID = r"blk_-?\d+"
MASK_RULES = [
    (r"blk_-?\d+", "<BLK>"),
    (r"/?\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d+)?", "<IP>"),
    (r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<UUID>"),
]
ERROR_WORDS = ["ERROR", "WARN", "EXCEPTION", "FAIL"]
UNKNOWN_TEXT = "unknown log template"
WILDCARD = "<*>"
PLACEHOLDER = r"<[A-Z*]+>"
# What Python's float() accepts for finite ASCII numbers, blanks and '_' included.
FLOAT_TEXT = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"
NONFINITE_TEXT = r"(?i)^\s*[+-]?(nan|inf|infinity)\s*$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def extract_block_id(col: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(col), BLOCK_ID, 0), F.lit(""))


def mask_tokens(col: Column | str, rules: Sequence[tuple[str, str]] = MASK_RULES) -> Column:
    out = _c(col)
    for pattern, mask in rules:
        out = F.regexp_replace(out, pattern, mask)
    return out


def strip_header(col: Column | str, n: int = 3) -> Column:
    return F.regexp_replace(_c(col), r"^(\S+\s+){%d}" % n, "")


def is_numeric(col: Column | str, finite_only: bool = False) -> Column:
    """Would Python's float() accept the text? `finite_only` also rejects nan and inf,
    and numbers too large for a double."""
    c = _c(col)
    plain = c.rlike(FLOAT_TEXT)
    if not finite_only:
        return F.coalesce(plain | c.rlike(NONFINITE_TEXT), F.lit(False))
    return F.coalesce(plain & (F.abs(_parsed(c)) < F.lit(float("inf"))), F.lit(False))


def _parsed(c: Column) -> Column:
    return F.translate(F.trim(c), "_", "").try_cast("double")


def to_number(col: Column | str, finite_only: bool = False) -> Column:
    """The number Python's float() reads, else null. Most are digits and a point, which need no pattern."""
    c = _c(col)
    plain = F.translate(c, "0123456789.", "") == ""
    return F.when(plain, c.try_cast("double")).otherwise(_patterned_number(c, finite_only))


def _patterned_number(c: Column, finite_only: bool) -> Column:
    value = F.when(c.rlike(FLOAT_TEXT), _parsed(c))
    if finite_only:
        return F.when(F.abs(value) < F.lit(float("inf")), value)
    named = F.when(c.rlike("(?i)nan"), F.lit(float("nan"))).when(
        F.trim(c).startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(c.rlike(FLOAT_TEXT), _parsed(c)).when(c.rlike(NONFINITE_TEXT), named)


def placeholder_value(token: Column, pattern: Column) -> Column:
    """Text of `token` that stands at the placeholder of a template token. Fixed text
    around the placeholder is cut off; adjacent placeholders give one value."""
    before = F.length(F.regexp_extract(pattern, r"^(.*?)<[A-Z*]+>", 1))
    after = F.length(F.regexp_extract(pattern, r"^.*<[A-Z*]+>(.*)$", 1))
    return F.substring(token, before + F.lit(1), F.length(token) - before - after)


def extract_parameters(content: Column | str, template: Column | str) -> Column:
    """Values at the placeholders of the template, in order; null when the token counts differ."""
    words, shape = F.split(_c(content), r"\s+"), F.split(_c(template), r"\s+")
    values = F.zip_with(
        words, shape, lambda w, t: F.when(t.rlike(PLACEHOLDER), placeholder_value(w, t))
    )
    return F.when(F.size(words) == F.size(shape), F.filter(values, lambda v: v.isNotNull()))


def keyword_flag(template: Column | str, words: Sequence[str] = ERROR_WORDS) -> Column:
    return F.coalesce(F.upper(_c(template)).rlike("|".join(words)), F.lit(False))


def log_scale(col: Column | str) -> Column:
    return F.log1p(F.abs(_c(col)))


def clip_nonneg(col: Column | str) -> Column:
    c = _c(col)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0)))


def finite_or(col: Column | str, default: float = 0.0) -> Column:
    c = _c(col)
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.lit(default)).otherwise(c)


def finite_array(col: Column | str, default: float = 0.0) -> Column:
    return F.transform(_c(col), lambda v: finite_or(v, default))


def coerce_json(col: Column | str, schema: str) -> Column:
    """Struct from JSON text; text that is not a JSON object gives null, not a struct of nulls."""
    c = _c(col)
    is_object = F.json_object_keys(c).isNotNull()
    return F.when(is_object, F.from_json(c, schema))


def pick_enrichment(large: Column | str, small: Column | str | None = None) -> Column:
    return _c(large) if small is None else F.coalesce(_c(large), _c(small))


def embedding_text(enriched_text: Column | str, template: Column | str) -> Column:
    def blank_to_null(c):
        return F.nullif(F.trim(_c(c)), F.lit(""))

    return F.coalesce(blank_to_null(enriched_text), blank_to_null(template), F.lit(UNKNOWN_TEXT))


def short_label(template: Column | str, n: int = 30) -> Column:
    return F.left(F.trim(F.substring_index(_c(template), ":", -1)), F.lit(n))


def preview(template: Column | str, n: int = 80) -> Column:
    return F.left(_c(template), F.lit(n))


def truncate_pad(ids: Column | str, length: int, pad: int = -1) -> Column:
    head = F.slice(_c(ids), 1, length)
    return F.concat(head, F.array_repeat(F.lit(pad), F.lit(length) - F.size(head)))


def l2_norm(vec: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(vec), F.lit(0.0), lambda a, x: a + x * x))


def l2_normalise(vec: Column | str) -> Column:
    v = _c(vec)
    norm = l2_norm(v)
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)
