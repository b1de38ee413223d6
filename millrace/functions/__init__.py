"""The dialect's functions: builders of native Spark expressions, by family, and a registry by SQL name."""

from . import aggregate, datetime, json, math, misc, net, string, window
from .registry import REGISTRY, call

__all__ = ["REGISTRY", "aggregate", "call", "datetime", "json", "math", "misc", "net", "string", "window"]
