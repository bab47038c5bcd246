"""All registered queries of the knowledge-graph engine, with their SQL."""

from __future__ import annotations

from importlib import import_module

#: modules with QUERIES {name: function(spark, sf_dir)} and ORACLES {name: SQL}
MODULES = ["quarry.queries.graph", "quarry.queries.algebra", "quarry.queries.evaluation", "quarry.queries.search", "quarry.queries.sources", "quarry.queries.store", "quarry.queries.candidates", "quarry.queries.explore", "quarry.queries.ranking"]
FLAGSHIP = "typed_path_3hop"


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(m).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(m).ORACLES.items()}
