"""Change-driven recomputation."""
