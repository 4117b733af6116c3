"""Cells of any storage class, and scalar functions over them and over ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A value with its own storage class, whatever its column declares.
CELL = "struct<storage:string,i:bigint,d:double,s:string,b:binary>"
#: Python's notion of a blank string.
BLANK = r"(?U)^[\s\x1c-\x1f]*$"
_STORAGE = {T.StringType: "text", T.BinaryType: "blob", T.DoubleType: "real", T.FloatType: "real", T.LongType: "integer", T.IntegerType: "integer", T.ShortType: "integer", T.ByteType: "integer", T.BooleanType: "integer"}


def cell(column: Column, kind: T.DataType) -> Column:
    """A column as a cell; struct columns are cells already."""
    if isinstance(kind, T.StructType):
        return column.cast(CELL)
    storage = _STORAGE.get(type(kind), "text")
    at = {"integer": "i", "real": "d", "text": "s", "blob": "b"}[storage]
    cast = {"i": "long", "d": "double", "s": "string", "b": "binary"}
    parts = [F.when(column.isNotNull(), F.lit(storage)).alias("storage")]
    parts += [(column.cast(t) if k == at else F.lit(None).cast(t)).alias(k) for k, t in cast.items()]
    return F.struct(*parts)


def blank(text: Column) -> Column:
    """Null or only white space."""
    return text.isNull() | text.rlike(BLANK)


def is_missing(c: Column) -> Column:
    """A null cell, or a text cell that is blank."""
    return c["storage"].isNull() | F.coalesce((c["storage"] == "text") & c["s"].rlike(BLANK), F.lit(False))


def matches_declared(storage: Column, declared: Column) -> Column:
    """Whether a storage class suits a declared type: the first of its parts
    that occurs in the declaration decides; any value suits an unknown one."""
    up = F.upper(declared)

    def has(*parts: str) -> Column:
        out = up.contains(parts[0])
        for p in parts[1:]:
            out = out | up.contains(p)
        return out

    return (
        F.when(has("INT"), storage == "integer")
        .when(has("REAL", "FLOA", "DOUB", "NUMERIC", "DECIMAL"), storage.isin("integer", "real"))
        .when(has("CHAR", "TEXT", "CLOB"), storage == "text")
        .when(has("BLOB"), storage == "blob")
        .otherwise(F.lit(True))
    )


def as_text(c: Column) -> Column:
    return F.coalesce(c["s"], c["i"].cast("string"), c["d"].cast("string"), F.concat(F.lit("<blob:"), F.lower(F.hex(c["b"])), F.lit(">")))


def python_type(storage: Column) -> Column:
    return F.when(storage == "integer", "int").when(storage == "real", "float").when(storage == "text", "str").when(storage == "blob", "bytes").otherwise("NoneType")


@F.pandas_udf(T.StringType())
def _quoted(values):  # noqa: ANN001, ANN201
    """repr() of texts that need more than quotes."""
    return values.map(lambda v: None if v is None else repr(v))


def python_repr(c: Column) -> Column:
    """repr() of a cell's value. Whole numbers and plain texts take no Python;
    reals, bytes, and texts with quotes, escapes or characters beyond ASCII are
    written by Python itself."""
    plain = c["s"].rlike(r"\A[\x20-\x26\x28-\x5B\x5D-\x7E]*\z")
    text = F.when(plain, F.concat(F.lit("'"), c["s"], F.lit("'"))).otherwise(_quoted(F.when(~plain, c["s"])))
    out = F.when(c["storage"] == "integer", c["i"].cast("string")).when(c["storage"] == "text", text)
    return out.when(c["storage"] == "real", _quoted_real(c["d"])).when(c["storage"] == "blob", _quoted_bytes(c["b"])).otherwise("None")


@F.pandas_udf(T.StringType())
def _quoted_real(values):  # noqa: ANN001, ANN201
    return values.map(lambda v: repr(float(v)))


@F.pandas_udf(T.StringType())
def _quoted_bytes(values):  # noqa: ANN001, ANN201
    return values.map(lambda v: None if v is None else repr(bytes(v)))


#: Id shapes in the order in which they are tried.
ID_SHAPES = [
    ("email_like", r"(?U)^[^@\s]+@[^@\s]+\.[^@\s]+$"),
    ("prefixed_id_like", r"(?U)^[a-zA-Z]+[-_:]\d+"),
    ("numeric_id_like", r"(?U)^\d+$"),
    ("human_name_like", r"^[A-Z][a-z]+(?: [A-Z][a-z]+)+$"),
    ("natural_language_like", r" "),
    ("opaque_token_like", r""),
]
#: Shapes that carry the name of a thing.
NAME_LIKE = ["human_name_like", "natural_language_like"]


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def classify_id(text: Column) -> Column:
    """The first shape whose pattern the id has."""
    shapes = F.array(*[F.when(stripped(text).rlike(pattern), name) for name, pattern in ID_SHAPES])
    return F.element_at(F.array_compact(shapes), 1)


def id_template(text: Column) -> Column:
    return F.regexp_replace(stripped(text), r"(?U)\d", "#")


def id_prefix(text: Column) -> Column:
    """The part before the first dash, else before the first underscore, of at
    most eight characters; empty without either."""
    dash, under = F.substring_index(text, "-", 1), F.substring_index(text, "_", 1)
    return F.substring(F.when(text.contains("-"), dash).when(text.contains("_"), under).otherwise(""), 1, 8)


def seed_of(anchor: Column, seed: int = 0) -> Column:
    """A 31-bit rolling hash of an id's characters."""
    chars = F.filter(F.split(anchor, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(seed).cast("long"), lambda h, c: (h * 131 + F.ascii(c)).bitwiseAND(F.lit(2147483647).cast("long")))


def sample_order(row_id: Column, seed: Column | int) -> Column:
    """A fixed pseudo-random order of row ids."""
    return (row_id % 2147483647 * 2654435761 + (F.lit(seed) if isinstance(seed, int) else seed)) % 2147483647


def to_affinity(text: Column, affinity: str) -> Column:
    """A proposed value in a column's affinity; null where it does not fit.
    Whole numbers keep all their digits."""
    if affinity == "INTEGER":
        number = text.try_cast("double")
        whole = F.when((number == F.floor(number)) & (F.abs(number) < 2.0**63), number.cast("long"))
        return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), text.try_cast("bigint")).otherwise(whole)
    if affinity == "REAL":
        return text.try_cast("double")
    return F.encode(text, "UTF-8") if affinity == "BLOB" else text


def relative_error(proposed: Column, truth: Column) -> Column:
    """Relative error of numbers; infinite against a zero truth; null for text."""
    p, t = proposed.try_cast("double"), truth.try_cast("double")
    return F.when(p.isNull() | t.isNull(), None).when(t == 0, F.when(p == 0, 0.0).otherwise(float("inf"))).otherwise(F.abs(p - t) / F.abs(t))


def same_text(proposed: Column, truth: Column) -> Column:
    return F.lower(F.trim(proposed)) == F.lower(F.trim(truth))
