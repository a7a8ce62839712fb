"""Typed configuration: YAML or JSON documents as dataclasses; unknown keys are errors, paths may come from the environment."""

from __future__ import annotations

import dataclasses
import json
import os
import re
import types
import typing
from collections.abc import Mapping
from typing import Any, TypeVar

T = TypeVar("T")
SHA256 = re.compile(r"[0-9a-f]{64}")


def parse(text: str) -> dict:
    """A document that must be a mapping; JSON where no YAML reader is installed."""
    try:
        import yaml
    except ImportError:
        value = json.loads(text)
    else:
        value = yaml.safe_load(text)
    if not isinstance(value, dict):
        raise ValueError("a configuration must be a mapping")
    return value


def _fit(value: Any, kind: Any, at: str) -> Any:
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin in (typing.Union, types.UnionType):
        if value is None and type(None) in args:
            return None
        return _fit(value, next(a for a in args if a is not type(None)), at)
    if dataclasses.is_dataclass(kind):
        return build(kind, value, at)
    if origin in (list, tuple):
        if not isinstance(value, (list, tuple)):
            raise ValueError(f"{at}: a list is needed")
        return origin(_fit(v, args[0], f"{at}[{i}]") for i, v in enumerate(value))
    if origin is dict:
        return {k: _fit(v, args[1], f"{at}.{k}") for k, v in value.items()}
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if kind in (int, float, str, bool) and (not isinstance(value, kind) or (kind is int and isinstance(value, bool))):
        raise ValueError(f"{at}: {kind.__name__} is needed, not {value!r}")
    return value


def build(model: type[T], values: Mapping[str, Any], at: str = "config") -> T:
    """An instance of a dataclass from a mapping, types checked, unknown and missing keys refused; then its own ``__post_init__`` checks."""
    if not isinstance(values, Mapping):
        raise ValueError(f"{at}: a mapping is needed")
    hints = typing.get_type_hints(model)
    fields = {f.name: f for f in dataclasses.fields(model)}
    unknown = sorted(set(values) - set(fields))
    missing = sorted(n for n, f in fields.items() if n not in values and f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING)
    if unknown or missing:
        raise ValueError(f"{at}: unknown keys {unknown}, missing keys {missing}")
    return model(**{k: _fit(v, hints[k], f"{at}.{k}") for k, v in values.items()})


def load(model: type[T], text: str, environment: Mapping[str, str] | None = None, prefix: str = "STUDY_") -> T:
    """A configuration document; ``PREFIX_NAME`` of the environment takes the place of a path ``name_path`` or ``name_root``."""
    values, environment = parse(text), os.environ if environment is None else environment
    for f in dataclasses.fields(model):
        if f.name.endswith(("_path", "_root")) and (own := environment.get(prefix + f.name.upper())):
            values[f.name] = own
    return build(model, values)


def unique(name: str, values) -> None:
    if len(set(values)) != len(values):
        raise ValueError(f"{name} repeat")


def digest_shape(name: str, value: str) -> None:
    if not SHA256.fullmatch(value):
        raise ValueError(f"{name} isn't a SHA-256 digest")


@dataclasses.dataclass(frozen=True)
class Sample:
    """A sample of articles of a universe between two dates."""

    tickers: tuple[str, ...]
    start: str
    end: str
    horizons: tuple[int, ...] = (1, 5, 21)
    per_company: int = 40
    size: int | None = None
    pool: int = 1000
    most: int = 1000

    def __post_init__(self):
        unique("tickers", self.tickers)
        unique("horizons", self.horizons)
        if 21 not in self.horizons:
            raise ValueError("the 21-session horizon is needed")
        if self.start >= self.end:
            raise ValueError("start must lie before end")
        if self.pool < self.most:
            raise ValueError("the pool is smaller than the sample")
        if self.size is not None and self.size != len(self.tickers) * self.per_company:
            raise ValueError("size must be companies times articles a company")


@dataclasses.dataclass(frozen=True)
class Model:
    """A priced model."""

    name: str
    input_price: float
    output_price: float

    def __post_init__(self):
        if min(self.input_price, self.output_price) <= 0:
            raise ValueError("prices must be positive")
        if "pro" in self.name.split("-"):
            raise ValueError("pro models aren't allowed")


@dataclasses.dataclass(frozen=True)
class Study:
    """A whole study: its sample, models, weights of the choice among them, and frozen inputs."""

    sample: Sample
    models: tuple[Model, ...]
    weights: dict[str, float]
    data_root: str = "data"
    input_hashes: dict[str, str] = dataclasses.field(default_factory=dict)

    def __post_init__(self):
        unique("models", [m.name for m in self.models])
        if abs(sum(self.weights.values()) - 1) > 1e-9:
            raise ValueError("weights must sum to 1")
        for name, value in self.input_hashes.items():
            digest_shape(name, value)


def extract(config: Mapping[str, Any], places: Mapping[str, str]) -> dict[str, Any]:
    """Values of a nested mapping by dotted place; a place that isn't there is an error."""
    out = {}
    for name, place in places.items():
        value: Any = config
        for step in place.split("."):
            if not isinstance(value, Mapping) or step not in value:
                raise ValueError(f"no {place} in the configuration")
            value = value[step]
        out[name] = value
    return out


def redacted(value: Any, secrets: tuple[str, ...] = ("key", "token", "secret", "password")) -> Any:
    """The value without what keys that sound secret hold: for logs and errors."""
    if isinstance(value, Mapping):
        return {k: "***" if any(s in str(k).lower() for s in secrets) else redacted(v, secrets) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [redacted(v, secrets) for v in value]
    return value
