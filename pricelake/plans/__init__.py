"""Registered queries, their SQL and the derivation of their inputs."""

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
