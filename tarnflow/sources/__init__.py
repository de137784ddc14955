"""Sources and sinks."""

from . import readers, writers
from .readers import CommandConfig, CSVConfig

__all__ = ["CSVConfig", "CommandConfig", "readers", "writers"]
