"""Saved settings: colours and names by class, read leniently from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.constants import CLASS_COLORS
from gridmill.functions.scalars import trimmed_or_null, valid_color

_SCHEMA = "labelColors array<string>, classNames array<string>"


def slots(classes: Column | int) -> Column:
    """0 … classes - 1; none if that is not a positive number."""
    n = classes if isinstance(classes, Column) else F.lit(classes)
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def sanitize(rows: DataFrame, raw: str, classes: int) -> DataFrame:
    """Adds ``label_colors`` and ``class_names`` with exactly a slot for each class; what is not valid is null."""
    at = lambda list_, k: F.get(F.from_json(F.col(raw), _SCHEMA)[list_], k)

    def color(k: Column) -> Column:
        return F.when(valid_color(at("labelColors", k)), at("labelColors", k))

    return rows.withColumns({
        "label_colors": F.transform(slots(classes), color),
        "class_names": F.transform(slots(classes), lambda k: trimmed_or_null(at("classNames", k))),
    })


def with_defaults(colors: Column, defaults: tuple[str, ...] = CLASS_COLORS) -> Column:
    """Valid saved colours over the defaults."""
    return F.transform(F.array(*map(F.lit, defaults)), lambda d, k: F.coalesce(F.get(colors, k), d))


def to_text(colors: Column, names: Column) -> Column:
    return F.to_json(F.struct(colors.alias("labelColors"), names.alias("classNames")), {"ignoreNullFields": "false"})
