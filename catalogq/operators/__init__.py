"""operators of catalogq."""
