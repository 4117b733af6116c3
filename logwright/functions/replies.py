"""What a resolver replies, and what a user types instead, as columns: fences
off, parsed, checked, coerced. Nothing raises; a bad reply has an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwright.functions.values import stripped


def strip_fences(reply: Column) -> Column:
    """The reply without a code fence around it; of a fence that opens and has
    no further line only its end goes."""
    text = stripped(reply)
    body = F.when(F.instr(text, "\n") > 0, F.regexp_replace(text, r"(?s)\A[^\n]*\n", "")).otherwise(text)
    body = F.regexp_replace(body, r"```\z", "")
    return stripped(F.when(text.startswith("```"), body).otherwise(text))


def parsed(reply: Column) -> Column:
    """The reply's JSON as a variant; null if it is none."""
    return F.try_parse_json(strip_fences(reply))


def _kind(value: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def as_str(value: Column, path: str, default: str = "") -> Column:
    """A text at ``path`` of a variant, without white space around it."""
    return F.when(_kind(value, path) == "STRING", stripped(F.try_variant_get(value, path, "string"))).otherwise(F.lit(default))


def as_bool(value: Column, path: str, default: bool = False) -> Column:
    return F.when(_kind(value, path) == "BOOLEAN", F.try_variant_get(value, path, "boolean")).otherwise(F.lit(default))


def as_enum(value: Column, path: str, allowed: list[str], default: str) -> Column:
    text = F.when(_kind(value, path) == "STRING", F.try_variant_get(value, path, "string"))
    return F.when(text.isin(allowed), text).otherwise(F.lit(default))


def as_str_list(value: Column, path: str, most: int = 8) -> Column:
    """The texts that are not blank among the first ``most`` items of a list."""
    items = F.slice(F.try_variant_get(value, path, "array<variant>"), 1, most)
    texts = F.transform(items, lambda x: F.when(F.schema_of_variant(x) == "STRING", stripped(F.try_variant_get(x, "$", "string"))))
    return F.coalesce(F.filter(texts, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def checked(reply: Column, fields: dict[str, str]) -> Column:
    """struct(value, error): the reply's variant, and what is wrong with it:
    not JSON, or the fields, of kinds such as string, boolean or double, that
    it lacks or has of another kind."""
    value = parsed(reply)
    numbers = ("bigint", "double", "int")

    def wrong(name: str, kind: str) -> Column:
        found = _kind(value, f"$.{name}")
        right = found.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)") if kind in numbers else found == kind.upper()
        return F.when(~F.coalesce(right, F.lit(False)), f"{name}: no {kind}")

    bad = F.array_join(F.array_compact(F.array(*[wrong(n, k) for n, k in fields.items()])), "; ")
    error = F.when(value.isNull(), "reply is not valid JSON").when(bad != "", bad)
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def parse_override(text: Column) -> Column:
    """struct(is_json, value): what a user typed, as JSON if it is that, else
    as it is; blank is empty text and null stays null."""
    value = F.try_parse_json(stripped(text))
    return F.struct(value.isNotNull().alias("is_json"), F.when(stripped(text) == "", "").when(value.isNotNull(), F.to_json(value)).otherwise(text).alias("value"))


def row_hash(issue: str, df: DataFrame, identity: list[str] | None = None) -> Column:
    """Sixteen hex digits over an issue and a violation's columns, in the order
    of their names, without those that begin with an underscore."""
    names = sorted(c for c in df.columns if not c.startswith("_") and c != "issue" and (not identity or c in identity))
    row = F.to_json(F.struct(F.lit(issue).alias("k"), F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in names]).alias("r")), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(row, 256), 1, 16)
