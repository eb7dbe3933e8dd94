"""Named queries over the driver's tables."""

import importlib

MODULES = ["boxes", "matching", "evaluation", "tracks", "poses", "catalog", "annotations", "search", "streams", "sources"]


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"visiontables.plans.{name}_queries")
