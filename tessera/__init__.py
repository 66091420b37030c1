"""tessera: language-model corpus preparation and evaluation as Spark jobs.

Every public function takes and returns a DataFrame (or a small, bounded
Python value such as a list of accepted merges). Subpackages:

- ``sources``   scans and sinks (line files, token streams, vocabularies, metrics)
- ``functions`` column-expression helpers (pre-tokenizer, hashing, losses)
- ``operators`` the relational building blocks (vocabulary, encode, pack, ...)
- ``plans``     end-to-end jobs composed from operators, plus the query catalog
- ``streaming`` the stateless line operators under Structured Streaming
"""

from tessera.config import Params

__all__ = ["Params"]

# Python helpers used inside pandas UDFs travel by value, so executors need
# not have this package installed (nothing to ship with --py-files).
try:  # pragma: no cover - depends on the pyspark build
    import sys as _sys

    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
