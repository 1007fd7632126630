"""Model output: unwrapping JSON, checking its shape and reading its text leaves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from worksignal.functions.text import let, not_blank, strip

_BRACES = "(?s)\\{.*\\}"
# Possessive throughout: a literal may be a whole document.
_LITERAL = '"[^"\\\\]*+(?:\\\\.[^"\\\\]*+)*+"(?:\\s*+:)?'


def extract_json(text: Column) -> Column:
    """The fenced block, else the outermost braces, else the text itself.

    The text is cut at its first two fences: a lazy pattern for the block would step through it twice.
    """
    return let(F.split(text, "```", 3), lambda parts: (
        F.when(F.size(parts) == 3, strip(F.regexp_replace(F.get(parts, F.lit(1)), "^json", "")))
        .when(text.rlike(_BRACES), F.regexp_extract(text, _BRACES, 0))
        .otherwise(text)
    ))


def leaf_strings(json_text: Column) -> Column:
    """String values of a JSON text at any depth, in order, keys left out.

    A quoted literal followed by a colon is a key; the value literals are unescaped together
    as one JSON array.
    """
    literals = F.regexp_extract_all(json_text, F.lit(_LITERAL), F.lit(0))
    values = F.filter(literals, lambda s: ~s.endswith(":"))
    return F.from_json(F.concat(F.lit("["), F.array_join(values, ","), F.lit("]")), "array<string>")


def leaf_text(json_text: Column) -> Column:
    return F.array_join(leaf_strings(json_text), " ")


def _type_name(value: Column) -> Column:
    """The JSON type of a variant, in the words used by the error texts."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.startswith("OBJECT"), F.lit("dict"))
        .when(kind.startswith("ARRAY"), F.lit("list"))
        .when(kind == "STRING", F.lit("str"))
        .when(kind == "BOOLEAN", F.lit("bool"))
        .when(kind == "BIGINT", F.lit("int"))
        .when(kind == "VOID", F.lit("NoneType"))
        .otherwise(F.lit("float"))
    )


def _item_errors(key: str, items: Column, required) -> Column:
    def check(item, index):
        name = F.concat(F.lit(f"'{key}["), index.cast("string"), F.lit("]'"))
        missing = F.array_compact(F.array(*[
            F.when(F.try_variant_get(item, f"$.{field}", "variant").isNull(), F.lit(f"'{field}'"))
            for field in required
        ]))
        # Only an object has keys, so the type is asked for where one is missing.
        return let(missing, lambda m: F.when(F.size(m) > 0, let(
            _type_name(item),
            lambda kind: F.when(kind != "dict", F.concat(name, F.lit(" expected an object, got "), kind)).otherwise(
                F.concat(name, F.lit(" missing keys: ["), F.array_join(m, ", "), F.lit("]"))
            ),
        )))

    return F.array_compact(F.transform(items, check))


def _parsed(json_text: Column) -> Column:
    """The text as a variant, NULL unless the whole text is one JSON value."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), json_text, F.lit("]")))
    return let(F.try_variant_get(wrapped, "$", "array<variant>"), lambda values: F.when(F.size(values) == 1, F.get(values, F.lit(0))))


def schema_errors(json_text: Column, required: dict) -> Column:
    """Shape errors of a JSON text; an empty array means it is valid.

    `required` maps each top-level key to the keys its items must have.
    """
    none = F.array().cast("array<string>")

    def key_errors(parsed, key, fields):
        return let(
            F.try_variant_get(parsed, f"$.{key}", "variant"),
            lambda value: F.when(value.isNull(), F.array(F.lit(f"Missing top-level key: '{key}'"))).otherwise(let(
                _type_name(value),
                lambda kind: F.when(
                    kind != "list", F.array(F.concat(F.lit(f"Expected '{key}' to be a list, got "), kind))
                ).otherwise(
                    _item_errors(key, F.try_variant_get(value, "$", "array<variant>"), fields) if fields else none
                ),
            )),
        )

    def errors(parsed):
        kind = _type_name(parsed)
        return (
            F.when(parsed.isNull(), F.array(F.lit("Not a JSON text")))
            .when(kind != "dict", F.array(F.concat(F.lit("Expected a JSON object at top level, got "), kind)))
            .otherwise(F.concat(none, *[key_errors(parsed, key, fields) for key, fields in required.items()]))
        )

    return let(_parsed(json_text), errors)


def field(json_text: Column, name: str) -> Column:
    """One top-level field of a JSON object as text."""
    return F.get_json_object(json_text, f"$.{name}")


def field_or(json_text: Column, name: str, default: str) -> Column:
    return F.coalesce(field(json_text, name), F.lit(default))


def filled_field_or(json_text: Column, name: str, default: str) -> Column:
    return F.coalesce(not_blank(field(json_text, name)), F.lit(default))
