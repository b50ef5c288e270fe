"""Reading untyped JSON documents with VARIANT, one bad record at a time.

A file read with a fixed schema loses every record when one is malformed. Here
each list element becomes its own VARIANT, so a bad element drops alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Appended to a text before parsing. The parser stops at the end of the first
# value, so only a text without trailing junk still ends in this mark.
_END = "\u0003end"
_END_JSON = '"\\u0003end"'

# Texts of empty values; the same texts in quotes are not empty.
_EMPTY = ("0", "0.0", "-0.0", "false", "[]", "{}")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed a single time per row.

    Catalyst copies an expression into every filter and projection above it.
    For a parser that repeats the parse, so the value goes through a
    one-element ``inline`` that later steps can only refer to by name.
    """
    values = [value.alias(name) for name, value in columns.items()]
    return df.select("*", F.inline(F.array(F.struct(*values))))


def with_document(docs: DataFrame, text: str = "value", name: str = "doc") -> DataFrame:
    """Add the text parsed to a VARIANT, NULL where it is not one JSON value."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), F.col(text), F.lit(f",{_END_JSON}]")))
    parsed = once(docs, _wrapped=wrapped)
    whole = F.try_variant_get("_wrapped", "$[1]", "string") == _END
    return parsed.withColumn(
        name, F.when(whole, F.try_variant_get("_wrapped", "$[0]", "variant"))
    ).drop("_wrapped")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed a single time, within one expression.

    Unlike :func:`once` it makes no column, so nothing is copied to a row."""
    return F.get(F.transform(F.array(value), use), 0)


def document(text: str = "value") -> Column:
    """The text as a VARIANT, as :func:`with_document` adds it."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), F.col(text), F.lit(f",{_END_JSON}]")))
    return let(wrapped, lambda w: F.when(
        F.try_variant_get(w, "$[1]", "string") == _END, F.try_variant_get(w, "$[0]", "variant")))


# What a typed reader accepts beyond the parser of VARIANTs, and a column for texts that don't fit.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "columnNameOfCorruptRecord": "\u0003bad"}


def typed(kind: str, fits: Callable[[Column], Column], listed: bool = False, plain: Column | None = None) -> Column:
    """The text in ``value`` read straight to an object of the type ``kind``, a struct or a map, or to a
    list of them; NULL where it is not one JSON value of this type, is not ``plain`` or doesn't fit.

    This is several times cheaper than a VARIANT, from which every value is cast by itself. A text
    field takes any other value, too, as it is spelled; ``plain``, a condition on the text, and
    ``fits``, one on what was read, tell where that could differ from a VARIANT's.
    """
    own_type, end = kind, f"{{{_END_JSON}:\"\"}}"
    if kind.startswith("struct<"):
        own_type = f"struct<`{_END}`: string, {kind.removeprefix('struct<')}"
    if listed:
        own_type, end = f"array<{own_type}>", f"[{end}]"
    # The last element tells trailing junk.
    wrapped = F.concat(F.lit(f"{{{_END_JSON}:["), F.col("value"), F.lit(f",{end}]}}"))
    if plain is not None:
        wrapped = F.when(plain, wrapped)
    read = F.from_json(wrapped, f"struct<`{_END}`: array<{own_type}>, `\u0003bad`: string>", _STRICT)

    def checked(r: Column) -> Column:
        own, last = F.get(r[_END], 0), F.get(r[_END], 1)
        whole = r["\u0003bad"].isNull() & (F.get(last, 0) if listed else last)[_END].isNotNull()
        return F.when(whole & own.isNotNull() & fits(own), own)

    return let(read, checked)


# Texts that may spell a list, an object or a number that a VARIANT spells in another way; one too
# large is spelled with quotes. Whole numbers and truth values read the same.
_SPELLED = r"^(?:[\[{\"]|-?[0-9]+[.eE]|-?[0-9]{18}|-0)"


def maybe_spelled(text: Column) -> Column:
    """Whether a text that was read may stand for a value of another type and differ from a VARIANT's."""
    first = F.ascii(text)
    # The first sign mostly decides.
    return text.isNotNull() & (((first >= 45) & (first <= 57)) | first.isin(34, 91, 123)) & text.rlike(_SPELLED)


def with_records(
    docs: DataFrame, fields: Sequence[str], texts: Sequence[str] = (), names: Sequence[str] = ()
) -> DataFrame:
    """Add ``items``: the text parsed to a list of records, NULL where it is no list.

    Each record is a struct, NULL for an element that is no object. ``fields`` are
    VARIANTs: a missing key is SQL NULL, a JSON null is a VARIANT null. ``texts`` and
    ``names`` are plain text with NULL for both; an empty value that is not a text
    (0, false, [] or {}) is NULL in ``names``.

    Parsing straight to the struct is several times cheaper than going through a VARIANT per
    element, but one element that is no object voids the file, and a value under a text key that
    is neither text nor null (a number, a list, an object) is written in its own spelling. Files
    with such elements or values are parsed again the slow way. A record with such a value is
    read the slow way in any file, so no record depends on its neighbours.
    """
    flat = ", ".join(
        [f"`{f}`: variant" for f in fields] + [f"`{t}`: string" for t in (*texts, *names)]
    )
    end = F.lit(f',[{{"_end":{_END_JSON}}}]]')
    wrapped = F.concat(F.lit("["), F.col("value"), end)
    # A wrapped date is unwrapped alike on both ways. A pattern for each key, as one that starts with
    # plain signs is looked for in steps of its length.
    after = r'\s*:\s*(?!\{\s*"\$date"\s*:)[^"n\s]'
    other = reduce(Column.__or__, [F.col("value").rlike(f'"{re.escape(k)}"{after}') for k in (*texts, *names)], F.lit(False))

    def as_record(r: Column) -> Column:
        return F.when(r.isNotNull(), F.struct(
            *[r[f].alias(f) for f in fields],
            *[text(r[t]).alias(t) for t in texts],
            *[F.when(_filled(r[n]), text(r[n])).alias(n) for n in names],
            F.lit(None).cast("string").alias("_end"),
        ))

    def careful(read: Column) -> Column:
        whole = F.try_variant_get(F.get(F.get(read, 1), 0), "$._end", "string") == _END
        return F.when(whole, F.transform(
            F.transform(F.get(read, 0), lambda x: record(x, (*fields, *texts, *names))), as_record))

    def chosen(read: Column) -> Column:
        whole = F.get(F.get(read, 1), 0)["_end"] == _END
        return F.when(whole & ~other, F.get(read, 0)).otherwise(
            let(F.from_json(wrapped, "array<array<variant>>"), careful))

    # One expression: a column for each step would copy the text and the records to rows of their own.
    return once(docs, items=let(F.from_json(wrapped, f"array<array<struct<{flat}, `_end`: string>>>"), chosen))


def record(value: Column | str, fields: Sequence[str]) -> Column:
    """An object's fields as a struct of VARIANTs, NULL for anything but an object.

    A missing key is SQL NULL, a JSON null is a VARIANT null.
    """
    ddl = ", ".join(f"`{f}`: variant" for f in fields)
    return F.try_variant_get(value, "$", f"struct<{ddl}>")


def records(
    docs: DataFrame,
    fields: Sequence[str],
    texts: Sequence[str] = (),
    names: Sequence[str] = (),
    per_file: int | None = None,
    keep_unreadable: bool = False,
) -> DataFrame:
    """One row per object of every list document: ``pos`` and ``rec``.

    See :func:`with_records` for the fields. ``per_file`` keeps every
    ``max(1, n // per_file)``-th element of a file. ``keep_unreadable`` adds a row
    with NULL ``pos`` for a file that is no list.
    """
    step = F.lit(1)
    if per_file is not None:
        # Known before the explode: no window over the records of a file.
        step = F.greatest(F.lit(1), F.floor(F.size("items") / per_file).cast("int"))
    kept = [c for c in docs.columns if c != "value"]
    # What depends on the whole list comes first: next to the explode it would make
    # every exploded row carry the list.
    sized = with_records(docs, fields, texts, names).select(
        *kept, F.col("items").isNull().alias("_unreadable"), step.alias("_step"), "items"
    )
    exploded = sized.select(
        *kept, "_unreadable", "_step", F.posexplode_outer("items").alias("pos", "rec")
    )
    if per_file is not None:
        exploded = exploded.where(F.col("_unreadable") | (F.col("pos") % F.col("_step") == 0))
    wanted = F.col("rec").isNotNull()
    if keep_unreadable:
        wanted = wanted | F.col("_unreadable")
    return exploded.where(wanted).drop("_step", "_unreadable")


def text(value: Column) -> Column:
    """A VARIANT as text; NULL for missing and for JSON null."""
    return F.try_variant_get(value, "$", "string")


def first_filled(*values: Column) -> Column:
    """The first VARIANT that is not empty (null, '', 0, false, [] or {}), as text.

    The higher-order form keeps the generated code of wide projections small enough
    for the JVM to compile; spelled out as nested conditions they run interpreted.
    """
    return F.get(F.transform(F.filter(F.array(*values), _filled), text), 0)


def _filled(value: Column) -> Column:
    as_text = text(value)
    empty = (as_text == "") | (as_text.isin(*_EMPTY) & (F.schema_of_variant(value) != "STRING"))
    return as_text.isNotNull() & ~empty


def is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def number(value: Column) -> Column:
    """A VARIANT as DOUBLE: numbers, true/false and numeric texts; NULL for others."""
    # The last sign is cheaper to look at than the type, and mostly decides.
    return F.when(~_suffixed(text(value)) | ~is_text(value), F.try_variant_get(value, "$", "double"))


def plain_number(value: Column) -> Column:
    """A VARIANT number as DOUBLE, NULL for any other value; without a cast of the VARIANT."""
    return let(F.to_json(value), lambda t: let(F.ascii(t), lambda first: F.when(
        (first == 45) | ((first >= 48) & (first <= 57)), t.try_cast("double"))))


def number_of_text(value: Column) -> Column:
    """A numeric text as DOUBLE, NULL for others."""
    return F.when(~_suffixed(value), value.try_cast("double"))


def _suffixed(value: Column) -> Column:
    """Casting accepts Java's type suffixes ("12d"), which are not numbers here."""
    return F.right(F.trim(value), F.lit(1)).isin("d", "f", "D", "F")


def text_or(value: Column, default: str, null_text: str) -> Column:
    """Text with one default for a missing key and another for JSON null."""
    return (
        F.when(value.isNull(), default)
        .when(F.is_variant_null(value), null_text)
        .otherwise(text(value))
    )


def flag(value: Column) -> Column:
    """Boolean: a missing key is false, JSON null stays NULL."""
    # Written as JSON, the common values are told apart without a cast, which costs more.
    return F.when(value.isNull(), F.lit(False)).otherwise(let(
        F.to_json(value), lambda t: F.when(t == "true", F.lit(True)).when(t == "false", F.lit(False))
        .when(t != "null", F.try_variant_get(value, "$", "boolean"))))


def items(value: Column) -> Column:
    """A VARIANT list as ARRAY<VARIANT>; NULL for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")
