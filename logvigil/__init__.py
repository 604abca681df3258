"""logvigil — Spark-native log anomaly analytics.

Every operator is a function ``f(df, ...) -> DataFrame`` that stays lazy: no
``collect`` inside operators except where a bounded artefact (a fitted forest,
a handful of scalars) must be materialised on purpose.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions and classes by value, so Python
    workers run pandas UDFs / applyInPandas without having logvigil on their
    path (no zip shipping, no per-node install)."""
    import sys

    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - pyspark absent or already registered
        pass


_ship_by_value()
