"""Training-data operators. Nothing outside this package imports it; the rest works without it."""
