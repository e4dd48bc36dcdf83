"""A cache of small query results on the driver, by arguments and for a time."""

from __future__ import annotations

import copy
import functools
import time
from collections import OrderedDict


def ttl_cache(seconds: float, size: int = 128, clock=time.monotonic):
    """Keeps up to `size` results for `seconds`; callers get copies, and errors are not kept."""

    def wrap(fn):
        kept: OrderedDict = OrderedDict()

        @functools.wraps(fn)
        def cached(*args, **kwargs):
            key = (args, tuple(sorted(kwargs.items())))
            if key in kept and clock() - kept[key][0] < seconds:
                kept.move_to_end(key)
                return copy.deepcopy(kept[key][1])
            value = fn(*args, **kwargs)
            kept[key] = clock(), value
            kept.move_to_end(key)
            while len(kept) > size:
                kept.popitem(last=False)
            return copy.deepcopy(value)

        cached.clear = kept.clear
        return cached

    return wrap
