"""All named queries; importing the modules registers them."""

from . import classification, modelling, quality, recordings, signals, statistics, verification, voices  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
