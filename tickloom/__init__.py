"""A PySpark-native engine for market-data time series; the names below are loaded when first used."""

from importlib import import_module

_HOMES = {
    "functions.clock": ["RTH", "Clock", "Session"],
    "functions.interval": ["Interval", "interval"],
    "functions.schema": ["ACTIONS", "BARS", "TICKS", "SchemaError", "kind_of"],
    "operators.adjust": ["adjust", "detect_splits"],
    "operators.indicators": ["Spec", "calc", "spec"],
    "operators.inspect": ["preview", "recent", "verify"],
    "operators.resample": ["resample"],
    "operators.stats": ["stat"],
    "plans.plot": ["chart"],
    "plans.request": ["bars"],
    "plans.store": ["BarStore", "stale"],
    "sources.discover": ["Settings", "discovered", "settings"],
    "streaming.download": ["Cancel", "download"],
    "streaming.ingest": ["Contract", "Provider", "ReplayProvider"],
    "sources.tables": ["load_actions", "union_sources", "window"],
}
_HOME = {name: home for home, names in _HOMES.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_HOME[name]}"), name)
