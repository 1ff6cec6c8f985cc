"""Functions of this package travel to executors by value, so executors need no copy of it on their path."""

import sys

from pyspark import cloudpickle


def by_value(name: str) -> None:
    """Marks the module called ``name`` to be pickled by value."""
    cloudpickle.register_pickle_by_value(sys.modules[name])
