"""Named queries over the shared test tables, each with its SQL statement where SQL can say it."""

from importlib import import_module

from velaria.plans.registry import ORACLES, QUERIES as ALL_QUERIES

MODULES = (
    "values", "masking", "intervals", "exposure", "feed", "keytables", "bodies", "streams", "people",
)
for _name in MODULES:
    import_module(f"velaria.plans.{_name}")

__all__ = ["ALL_QUERIES", "ORACLES"]
