"""Price positioning for rental-style markets, as Spark DataFrame jobs."""

from peerband.params import DEFAULTS, Params

__all__ = ["DEFAULTS", "Params"]
