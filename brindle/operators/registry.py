"""Models by name, for kernels.blend, with options that may come as text."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

from .kernels import blur

Model = Callable[[np.ndarray], np.ndarray]
#: Of each name, in lower case without underscores: what makes the model, and its options' defaults.
MODELS: dict[str, tuple[Callable[..., Model], dict]] = {}


def _plain(name: str) -> str:
    return name.replace("_", "").lower()


def model(name: str, **defaults) -> Callable:
    """Registers a maker of shape-preserving models under a name, with its options' defaults."""

    def put(make: Callable[..., Model]) -> Callable[..., Model]:
        MODELS[_plain(name)] = make, defaults
        return make

    return put


def options(name: str, **given) -> dict:
    """A model's options: the given ones, as the type of their defaults, over the defaults. Unknown names are errors."""
    if _plain(name) not in MODELS:
        raise KeyError(f"no model {name}; there are {sorted(MODELS)}")
    defaults = MODELS[_plain(name)][1]
    if unknown := given.keys() - defaults.keys():
        raise KeyError(f"{name} has no options {sorted(unknown)}")
    return {k: type(v)(given.get(k, v)) for k, v in defaults.items()}


def create(name: str, **given) -> Model:
    """The model of a name, whatever its case and underscores."""
    chosen = options(name, **given)
    return MODELS[_plain(name)][0](**chosen)


def three(values: Iterable | None) -> list[int] | None:
    """One or three numbers as three."""
    if values is None:
        return None
    found = [int(v) for v in values]
    if len(found) not in (1, 3):
        raise ValueError(f"1 or 3 values are expected, not {len(found)}")
    return found * 3 if len(found) == 1 else found


def numbers(text: str) -> list[int]:
    """The numbers of a list with commas that aren't negative: "0,2" names two devices, "-1" none."""
    return [n for n in map(int, filter(None, map(str.strip, text.split(",")))) if n >= 0]


@model("identity")
def _identity() -> Model:
    return lambda x: x


@model("scaled", factor=1.0)
def _scaled(factor: float) -> Model:
    return lambda x: factor * x


@model("blurred", sigma=1.0)
def _blurred(sigma: float) -> Model:
    return lambda x: blur(x, sigma)
