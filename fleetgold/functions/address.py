"""Table keys, versions and paths as column expressions.

A table key is ``layer:namespace:name:version``. Nothing here shuffles; every
function takes and returns a ``Column``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DEFAULT_LAYER = "gold"
KEY_SEPARATOR = ":"
CLEANED_VERSION = "v1.0.0"
LAYOUT_COORDINATES = "coordinates"
LAYOUT_SHORT = "short"


def table_key(layer: Column, namespace: Column, name: Column, version: Column) -> Column:
    """Build a table key. Null if any part is null."""
    sep = F.lit(KEY_SEPARATOR)
    return F.concat(layer, sep, namespace, sep, name, sep, version)


def key_part(key: Column, part: str) -> Column:
    """One part of a table key; the empty string if the key is too short."""
    position = ["layer", "namespace", "name", "version"].index(part) + 1
    return F.split_part(key, F.lit(KEY_SEPARATOR), F.lit(position))


def clean_version(version: Column) -> Column:
    """Drop the leading ``v`` of versions that start with ``v1.0.0``; keep all others."""
    return F.when(
        version.startswith(CLEANED_VERSION), F.substr(version, F.lit(2))
    ).otherwise(version)


def cleaned(version: str) -> str:
    """``clean_version`` of one value."""
    return version[1:] if version.startswith(CLEANED_VERSION) else version


def layer_or_default(layer: Column) -> Column:
    return F.coalesce(F.nullif(layer, F.lit("")), F.lit(DEFAULT_LAYER))


def result_path(
    layout: Column,
    root: Column,
    tenant_id: Column,
    layer: Column,
    version: Column,
    namespace: Column,
    name: Column,
) -> Column:
    """Path of a result table.

    ``coordinates``: root / tenant / layer / version / namespace / name.
    ``short``: root / tenant / layer / name.
    Null where ``address_problem`` names a problem.
    """
    sep = F.lit("/")
    head = F.concat(root, sep, tenant_id, sep, layer_or_default(layer))
    full = F.concat(head, sep, version, sep, namespace, sep, F.nullif(name, F.lit("")))
    short = F.concat(head, sep, F.nullif(name, F.lit("")))
    return F.when(layout == LAYOUT_COORDINATES, full).when(layout == LAYOUT_SHORT, short)


def address_problem(layout: Column, version: Column, namespace: Column, name: Column) -> Column:
    """Why no result path can be built, or null."""
    return (
        F.when(F.coalesce(name, F.lit("")) == "", F.lit("NO_NAME"))
        .when(
            ~F.coalesce(layout.isin(LAYOUT_COORDINATES, LAYOUT_SHORT), F.lit(False)),
            F.lit("UNKNOWN_LAYOUT"),
        )
        .when(
            (layout == LAYOUT_COORDINATES) & (version.isNull() | namespace.isNull()),
            F.lit("INCOMPLETE_COORDINATES"),
        )
    )


def required_path(path: Column, problem: Column) -> Column:
    """The path, or a failing job that names the problem."""
    return F.coalesce(
        path, F.raise_error(F.concat(F.lit("no result path: "), F.coalesce(problem, F.lit("null part")))).cast("string")
    )
