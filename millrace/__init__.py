"""Raw pages and loose records to clean entity tables, on Spark.

The names below are the public interface; each is imported when it is first used.
"""

from importlib import import_module

_HOMES = {
    "session": ("build_session", "configure", "Workspace"),
    "functions.dates": ("normalize_date", "is_fresh", "in_window"),
    "functions.text": ("strip_boilerplate", "estimate_tokens"),
    "functions.names": ("exact_key", "normalized_key"),
    "functions.records": ("validate_reply",),
    "operators.chunking": ("chunk_documents",),
    "operators.resolve": ("resolve", "mapping_log", "ElectionLimits"),
    "operators.extract": ("extract",),
    "operators.fetch": ("fetch_pages", "fetch_log", "FetchConfig", "look_up_stars", "enrich_stars"),
    "plans.outputs": ("build_tables",),
    "sources.seeds": ("read_seed_file", "seed_aliases"),
    "sources.providers": ("Provider",),
}
_HOME_OF = {name: home for home, names in _HOMES.items() for name in names}
__all__ = sorted(_HOME_OF)


def __getattr__(name: str):
    if name not in _HOME_OF:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f".{_HOME_OF[name]}", __name__), name)
