"""Memory of the Python workers, which Spark reuses from stage to stage."""
import ctypes
import gc
from functools import wraps

import pyarrow as pa

_held: dict = {}


def kept(name, make):
    """What tasks of one operator keep in their worker from task to task: the
    object made by ``make``. A worker holds one; asked for another, it lets the
    one before go and gives its memory back to the system."""
    if name not in _held:
        _held.clear()
        give_back()
        _held[name] = make()
    return _held[name]


def give_back() -> None:
    gc.collect()
    trim()


def trim() -> None:
    """Give memory that is free now back to the system; between batches, this keeps the
    arrays of one from standing beside those of the next."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def acyclic(function):
    """Run a function that makes very many small objects, none of them in cycles,
    without the collector going over them again and again."""

    @wraps(function)
    def run(*args):
        on = gc.isenabled()
        gc.disable()
        try:
            return function(*args)
        finally:
            if on:
                gc.enable()

    return run
