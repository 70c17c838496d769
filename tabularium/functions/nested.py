"""JSON text and vector columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def json_get(c: Column, path: str) -> Column:
    """Value at a dotted path as text, null where it is missing."""
    return F.get_json_object(c, "$." + path)


def json_merge(left: Column, right: Column) -> Column:
    """Flat JSON objects merged, the right one winning; keys come out sorted."""
    as_map = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(as_map(left), lambda k, _: ~F.map_contains_key(as_map(right), k))
    entries = F.array_sort(F.map_entries(F.map_concat(kept, as_map(right))))
    return F.to_json(F.map_from_entries(entries))


def l2_normalise(c: Column) -> Column:
    """Vector divided by its length plus 1e-10, in double precision."""
    wide = F.transform(c, lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(wide, lambda x: x / (size + F.lit(1e-10)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)
