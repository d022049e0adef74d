"""streaming of catalogq."""
