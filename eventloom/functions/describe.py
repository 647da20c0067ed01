"""Labels and categories from the JSON descriptions of types: [label, description, [[annotation, [argument, ...]], ...]]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Annotations of experimental types and of categories, and how the former are marked in labels.
EXPERIMENTAL, CATEGORY = "jdk.jfr.Experimental", "jdk.jfr.Category"
MARK = " (Experimental)"


def type_label(description: Column, name: Column) -> Column:
    """The label of a type, marked if it is experimental; without one, the type's name."""
    label = F.nullif(F.get_json_object(description, "$[0]"), F.lit(""))
    return F.when(label.isNull(), name).otherwise(F.concat(label, F.when(description.contains(EXPERIMENTAL), MARK).otherwise("")))


def plain_label(label: Column) -> Column:
    """A label as it is shown in cells."""
    return F.regexp_replace(label, r" \(Experimental\)$", "")


def categories(description: Column) -> Column:
    """The path of categories of a type, outermost first; empty if it has none."""
    notes = F.from_json(F.get_json_object(description, "$[2]"), "array<array<string>>")
    own = F.filter(notes, lambda a: F.try_element_at(a, F.lit(1)) == CATEGORY)
    path = F.from_json(F.try_element_at(F.try_element_at(own, F.lit(1)), F.lit(2)), "array<array<string>>")
    return F.coalesce(F.try_element_at(path, F.lit(1)), F.array().cast("array<string>"))


def field_label(description: Column) -> Column:
    """The label of a field, the fourth element of its description."""
    return F.get_json_object(description, "$[3]")
