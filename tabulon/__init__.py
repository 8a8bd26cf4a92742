"""Profiling, quality reports, preparation and model selection for Spark DataFrames.

Names are loaded when they are first asked for: every Python worker imports this package, and most need a part of it.
"""

from importlib import import_module

_PLACES = {
    "tabulon.operators.inference": ("column_types", "column_verdicts", "dataset_info", "problem_type", "target_suggestions"),
    "tabulon.operators.profile": ("profile",),
    "tabulon.plans.exploration": ("explore",),
    "tabulon.plans.prediction": ("feature_importance", "predict", "score"),
    "tabulon.plans.preparation": ("prepare",),
    "tabulon.plans.quality": ("quality_report",),
    "tabulon.plans.training": ("train_models",),
    "tabulon.sources.readers": ("read_csv", "read_table"),
}
_HOME = {name: place for place, names in _PLACES.items() for name in names}

__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    globals()[name] = found = getattr(import_module(_HOME[name]), name)
    return found


def __dir__() -> list[str]:
    return sorted({*globals(), *__all__})
