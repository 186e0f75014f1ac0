"""The package's own code for the Python workers."""

from ledgerlens.ship import ship

__all__ = ["ship"]
