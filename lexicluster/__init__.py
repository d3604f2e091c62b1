"""lexicluster: distributed text clustering and cluster explanation on Spark DataFrames.

Every operator takes and returns DataFrames; Python code on executors is limited to
Arrow-batched NumPy work (network gradients, Gibbs resampling), never per-row loops.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Functions of this package that run inside Python tasks (mapInPandas bodies) are pickled by
    value, so executors need no installed copy of the package."""
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
