"""JSON paths and templates.

A path is configuration: either one for all rows, compiled into VARIANT lookups, or a
column, where each row brings the path of its own source.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text_or_empty


def _items(value: Column) -> Column:
    """The elements of a JSON list, NULL when the value is no list."""
    return F.try_variant_get(value, "$", "array<variant>")


def _leaf(value: Column) -> Column:
    listed = F.try_variant_get(value, "$", "array<string>")
    single = F.try_variant_get(value, "$", "string")
    return F.coalesce(listed, F.when(single.isNotNull(), F.array(single)))


def dig_values(value: Column, path: str) -> Column:
    """All texts a dot path leads to, as an array (NULL when nothing is there).

    A number picks a list element; any other name met at a list is looked up in
    every element of it.  The path is compiled into nested VARIANT lookups once,
    on the driver.
    """
    return _walk(value, path.split(".") if path else [], mapped=False)


def _walk(value: Column, parts: list[str], mapped: bool) -> Column:
    if not parts:
        return _leaf(value)
    name, rest = parts[0], parts[1:]
    if name.isdigit():
        listed = _walk(F.try_variant_get(value, f"$[{name}]", "variant"), rest, False)
    elif mapped:
        return _walk(F.try_variant_get(value, f"$.{name}", "variant"), rest, False)
    else:
        listed = F.flatten(
            F.transform(
                _items(value),
                lambda item: F.coalesce(
                    _walk(item, parts, True), F.array().cast("array<string>")
                ),
            )
        )
    keyed = _walk(F.try_variant_get(value, f"$.{name}", "variant"), rest, False)
    return F.when(_items(value).isNotNull(), listed).otherwise(keyed)


def dig_text(value: Column, path: str | None, sep: str = "; ") -> Column:
    """The path's texts joined, the empty text when the path leads nowhere."""
    if not path:
        return F.lit("")
    return text_or_empty(F.array_join(dig_values(value, path), sep))


def dig_list(value: Column, path: str | None) -> Column:
    """The list of objects a path leads to, NULL when there is no list.

    Used for the record list of a payload, so a list is not mapped over here.
    """
    for name in path.split(".") if path else []:
        step = f"$[{name}]" if name.isdigit() else f"$.{name}"
        value = F.try_variant_get(value, step, "variant")
    return _items(value)


def _keyed(value: Column, name: Column) -> Column:
    # A map lookup: a VARIANT path that differs by row would be parsed for every row.
    return F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), name)


def _steps(path: Column) -> Column:
    return F.when(text_or_empty(path) == "", F.array().cast("array<string>")).otherwise(F.split(path, "[.]"))


def _place(name: Column) -> Column:
    return F.when(name.rlike("^[0-9]+$"), name.try_cast("int"))


def dig_text_by(value: Column, path: Column, sep: str = "; ") -> Column:
    """As `dig_text`, with a path per row."""

    def further(values: Column, name: Column) -> Column:
        def step(v: Column) -> Column:
            listed = F.when(_place(name).isNotNull(), F.array(F.get(_items(v), _place(name)))).otherwise(
                F.transform(_items(v), lambda item: _keyed(item, name))
            )
            return F.when(_items(v).isNotNull(), listed).otherwise(F.array(_keyed(v, name)))

        return F.filter(F.flatten(F.transform(values, step)), lambda v: v.isNotNull())

    found = F.aggregate(_steps(path), F.array(value), further)
    leaves = F.flatten(F.transform(found, lambda v: F.coalesce(_leaf(v), F.array().cast("array<string>"))))
    return F.when(text_or_empty(path) == "", F.lit("")).otherwise(text_or_empty(F.array_join(leaves, sep)))


def dig_list_by(value: Column, path: Column) -> Column:
    """As `dig_list`, with a path per row."""
    return _items(F.aggregate(
        _steps(path), value,
        lambda v, name: F.when(_place(name).isNotNull(), F.get(_items(v), _place(name))).otherwise(_keyed(v, name)),
    ))


def as_text(value: Column, sep: str = "; ") -> Column:
    """A JSON field that may be a list or a scalar, as one text.

    Such fields are declared STRING, so a list arrives as its JSON text.
    """
    listed = F.from_json(value, "array<string>")
    return text_or_empty(
        F.when(value.rlike(r"^\s*\["), F.array_join(listed, sep)).otherwise(value)
    )


def fill_template(template: str, **columns: Column) -> Column:
    """Replace `{name}` in a configured template by a column's value."""
    out: Column = F.lit(template)
    for name, column in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), column)
    return out
