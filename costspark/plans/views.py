"""Named views that read one another: built in the order they need."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from costspark.sources.sinks import save_view

View = str | Callable[[SparkSession], DataFrame]


def references(spark: SparkSession, text: str) -> set[str]:
    """Names of tables that SQL text reads, as Spark parses it: in joins, subqueries and WITH parts too."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    names = re.findall(r"UnresolvedRelation \[([^\]]+)\]", plan.toString())
    return {name.split(", ")[-1].strip("`").lower() for name in names}


def order_views(
    spark: SparkSession, views: Mapping[str, View], needs: Mapping[str, Sequence[str]] | None = None
) -> list[str]:
    """The names of ``views``, each after those that it reads.

    SQL text tells what it reads; for a function, ``needs`` may.  Names that are no views are tables
    that exist.  Views that need each other are an error that names them.
    """
    known = {name.lower(): name for name in views}
    graph: dict[str, set[str]] = {}
    for name, view in views.items():
        read = references(spark, view) if isinstance(view, str) else set()
        read |= {n.lower() for n in (needs or {}).get(name, ())}
        graph[name] = {known[r] for r in read if r in known}
    try:
        return list(TopologicalSorter(graph).static_order())
    except CycleError as e:
        raise ValueError("views need each other: " + " <- ".join(e.args[1])) from None


def build_views(
    spark: SparkSession,
    layers: Mapping[str, View] | Sequence[Mapping[str, View]],
    path: str | None = None,
    needs: Mapping[str, Sequence[str]] | None = None,
) -> dict[str, DataFrame]:
    """Create every view: in the order they need (``order_views``), or layer by layer if layers are given.

    A view is SQL text over other names or a function of the session.  With
    ``path`` each view is written there and bound to the written table, so a
    later view reads it instead of computing it again.
    """
    built: dict[str, DataFrame] = {}
    if isinstance(layers, Mapping):
        layers = [{name: layers[name]} for name in order_views(spark, layers, needs)]
    for layer in layers:
        for name, view in layer.items():
            df = spark.sql(view) if isinstance(view, str) else view(spark)
            if path:
                built[name] = save_view(df, name, f"{path}/{name}")
            else:
                df.createOrReplaceTempView(name)
                built[name] = df
    return built
