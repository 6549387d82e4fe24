"""Named queries over the given tables."""

import importlib

FAMILIES = ("text", "labels", "vectors", "agreement", "aggregates", "coordinates",
            "multivariate", "resampling", "faithfulness", "scores", "variants", "splits", "files")


def load_catalogue():
    from compovec.plans.registry import CATALOGUE
    for family in FAMILIES:
        importlib.import_module(f"compovec.plans.{family}")
    return CATALOGUE
