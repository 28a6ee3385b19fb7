"""Spark-native inference of overlapping communities in large graphs."""

from .config import Config, Noise, Strategy

__all__ = ["Config", "Learner", "Noise", "Strategy"]


def __getattr__(name: str):
    if name == "Learner":
        from .plans.learner import Learner

        return Learner
    raise AttributeError(name)
