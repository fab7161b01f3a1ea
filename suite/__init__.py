"""Registered queries: the driver's tables bound to the market shapes, with reference SQL."""
