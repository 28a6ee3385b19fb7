"""Settings of a run, and the named choices in them."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields, replace
from enum import Enum


class Strategy(Enum):
    """How a mini-batch of vertex pairs is drawn."""

    NODE = "Node"
    NODE_LINK = "NodeLink"
    NODE_NON_LINK = "NodeNonLink"
    BF = "BF"
    BF_LINK = "BFLink"
    BF_NON_LINK = "BFNonLink"

    @classmethod
    def parse(cls, text: str) -> Strategy:
        """Names are read without regard to case."""
        for s in cls:
            if s.value.lower() == text.strip().lower():
                return s
        raise ValueError(f"unknown strategy {text!r}: one of {', '.join(s.value for s in cls)}")


class Noise(Enum):
    GAUSSIAN = "gaussian"
    ZERO = "zero"
    ONE = "one"


@dataclass(frozen=True)
class Config:
    """Model and sampling parameters. alpha=0 means 1/k."""

    k: int = 32
    mini_batch: int = 32
    neighbors: int = 32
    heldout_ratio: float = 0.01
    alpha: float = 0.0
    a: float = 0.0315
    b: float = 1024.0
    c: float = 0.5
    epsilon: float = 1e-7
    eta0: float = 1.0
    eta1: float = 1.0
    ppx_interval: int = 100
    max_iters: int = 100
    strategy: Strategy = Strategy.NODE
    noise: Noise = Noise.GAUSSIAN
    theta_noise: Noise | None = None
    seed: int = 42
    train_ppx_ratio: float = 0.01
    compact_every: int = 20
    prefetch: bool = True

    def __post_init__(self) -> None:
        for name, ok in (
            ("k", self.k >= 1), ("mini_batch", self.mini_batch >= 1), ("neighbors", self.neighbors >= 1), ("heldout_ratio", 0 <= self.heldout_ratio < 2),
            ("epsilon", 0 < self.epsilon < 1), ("eta0", self.eta0 > 0), ("eta1", self.eta1 > 0), ("ppx_interval", self.ppx_interval >= 1), ("b", self.b > 0),
        ):
            if not ok:
                raise ValueError(f"{name}={getattr(self, name)} is out of range")

    @property
    def prior(self) -> float:
        return self.alpha if self.alpha > 0 else 1.0 / self.k

    @property
    def noise_of_theta(self) -> Noise:
        return self.theta_noise or self.noise

    def step_size(self, t: int) -> float:
        """a * (1 + t/b) ** -c for the t-th update, counted from 1."""
        return self.a * math.pow(1 + t / self.b, -self.c)

    def with_(self, **changes) -> Config:
        return replace(self, **changes)

    def describe(self) -> str:
        return "\n".join(f"{f.name}: {v.value if isinstance(v := getattr(self, f.name), Enum) else v}" for f in fields(self))

    def to_dict(self) -> dict:
        return {f.name: v.value if isinstance(v := getattr(self, f.name), Enum) else v for f in fields(self)}

    @classmethod
    def from_dict(cls, d: dict) -> Config:
        kinds = {"strategy": Strategy, "noise": Noise, "theta_noise": Noise}
        return cls(**{k: kinds[k](v) if k in kinds and v is not None else v for k, v in d.items()})
