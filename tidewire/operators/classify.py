"""Rules against texts: topics, urgency, audiences, sensitivity, places, entities, redaction, private data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import text as T

#: Patterns of what is taken out of notes, in this order.
REDACTIONS = (
    ("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+"), ("secret", "(password|token|secret|key)=[A-Za-z0-9]+"),
    ("handle", "@[A-Za-z0-9_]{2,}"), ("phone", "\\+?[0-9][0-9 ().-]{7,}[0-9]"),
)


#: What a text must hold for a pattern to be in it.
REDACTED_WITH = {"email": "@", "secret": "=", "handle": "@"}
#: A text of one run of letters is read once: an address begins where a run begins or the last match ended, and if it can't there,
#: it can't begin further on in the run. The same matches as without.
RUN_START = "(?:\\G|(?<![A-Za-z0-9._%+-]))"


def redacted(rows: DataFrame, text: str, kinds: str = "kinds") -> DataFrame:
    """rows with marks in place of a text's private parts, and the names of the kinds that were there as an array. Each pattern is a
    step of its own, so what one step found is not worked out again by the next ones; no mark is what it stands for, so a kind was
    there if its step changed the text."""
    rows = rows.withColumn("__0", F.col(text))
    for k, (name, pattern) in enumerate(REDACTIONS):
        was = F.col(f"__{k}")
        out = F.regexp_replace(was, RUN_START + pattern.replace("]+@", "]++@") if name == "email" else pattern, f"[{name}]")
        rows = rows.withColumn(f"__{k + 1}", F.when(F.contains(was, F.lit(REDACTED_WITH[name])), out).otherwise(was) if name in REDACTED_WITH else out)
    seen = [F.when(F.col(f"__{k}") != F.col(f"__{k + 1}"), name) for k, (name, _) in enumerate(REDACTIONS)]
    steps = range(len(REDACTIONS) + 1)
    return rows.withColumns({kinds: F.array_compact(F.array(*seen)), text: F.col(f"__{len(REDACTIONS)}")}).drop(*[f"__{k}" for k in steps])


FORBIDDEN_KEYS = ("email", "phone", "user_name", "handle", "password", "token")


def forbidden_columns(df: DataFrame, keys: tuple[str, ...] = FORBIDDEN_KEYS) -> list[str]:
    """Paths of forbidden names anywhere in a nested schema; known without reading a row."""
    from pyspark.sql.types import ArrayType, MapType, StructType

    def walk(kind, path: str) -> list[str]:
        if isinstance(kind, StructType):
            return [p for f in kind.fields for p in ([f"{path}{f.name}"] if f.name.lower() in keys else []) + walk(f.dataType, f"{path}{f.name}.")]
        if isinstance(kind, ArrayType):
            return walk(kind.elementType, path)
        return walk(kind.valueType, path) if isinstance(kind, MapType) else []

    return walk(df.schema, "")


def entities(text: Column) -> Column:
    """Capitalised words that follow a lower-case word or comma, distinct, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z,] ([A-Z][a-z]+)"), F.lit(1)))


def conform(df: DataFrame, columns: dict[str, tuple[str, str | None, tuple[str, ...] | None]], aliases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The given columns as name -> (type, default, allowed values): the first of a column's aliases that is there and not
    empty, cast (or null), values outside the allowed ones set to the default."""
    out = []
    for name, (kind, default, allowed) in columns.items():
        found = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in (name, *(aliases or {}).get(name, ())) if c in df.columns]
        value = (F.coalesce(*found) if found else F.lit(None)).try_cast(kind)
        if allowed:
            value = F.when(value.isin(*allowed), value)
        out.append((F.coalesce(value, F.lit(default).cast(kind)) if default is not None else value).alias(name))
    return df.select(*out)


def failures(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks; a rule that is null counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
