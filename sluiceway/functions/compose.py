"""Functions of functions."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from typing import Any


class Compose:
    """Compose(f, g, h)(x) is f(g(h(x)))."""

    def __init__(self, *fns: Callable[..., Any]):
        if not fns:
            raise ValueError("at least one function is needed")
        self.fns = fns

    def __call__(self, *args: Any, **kwargs: Any) -> Any:
        *outer, inner = self.fns
        return reduce(lambda value, fn: fn(value), reversed(outer), inner(*args, **kwargs))


class RunAll:
    """Calls each function, in order, with the same arguments; returns nothing."""

    def __init__(self, *fns: Callable[..., Any]):
        self.fns = fns

    def __call__(self, *args: Any, **kwargs: Any) -> None:
        for fn in self.fns:
            fn(*args, **kwargs)


@contextmanager
def chdir(path: str) -> Iterator[None]:
    """Another working directory, left again whatever happens."""
    before = os.getcwd()
    os.chdir(path)
    try:
        yield
    finally:
        os.chdir(before)
