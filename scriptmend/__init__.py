"""Analytics for restoring missing text, as DataFrame and SQL plans."""
