"""Path columns, with ``/`` between segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """All before the last slash; empty for a file at the root."""
    return F.when(path.contains("/"), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def top_directory(path: Column, root: str = "root") -> Column:
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise(F.lit(root))


def file_type(path: Column) -> Column:
    """What follows the last dot of the whole path, in lower case; a path without a dot is its own type."""
    return F.lower(F.substring_index(path, ".", -1))


def suffix(path: Column) -> Column:
    """The last extension of the file name with its dot, in lower case; a name's leading dot begins no extension."""
    return F.lower(F.regexp_extract(basename(path), r"^.+?(\.[^.]+)$", 1))


def normalised(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments, as far as they can be undone."""

    def step(done: Column, part: Column) -> Column:
        last = F.element_at(F.concat(F.array(F.lit("..")), done), -1)
        return (
            F.when((part == "") | (part == "."), done)
            .when((part == "..") & (last != ".."), F.slice(done, F.lit(1), F.size(done) - 1))
            .otherwise(F.array_append(done, part))
        )

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
