"""riftscan: structural-variant discovery from long-read alignments as Spark queries."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Task closures carry this package's helpers by value, so a job needs no --py-files to run on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def __getattr__(name: str):
    """The run and the presets, loaded when they are asked for."""
    if name in ("RunConfig", "run_inference"):
        from .plans import inference
        return getattr(inference, name)
    if name == "select_preset":
        from .presets import select_preset
        return select_preset
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
