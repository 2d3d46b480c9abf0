"""threadlens: Spark-native analytics for tables of online discussions.

Every public operator takes and returns Spark DataFrames. Column roles
(post id, comment id, time, topic, labels, user, text) are keyword
arguments so the same operator serves any table that carries them.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value so Python workers (Pandas UDFs,
    mapInPandas) need no installed copy of it on executors."""
    import sys

    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older cloudpickle: fall back to --py-files / PYTHONPATH
        pass


_ship_by_value()
