"""sources of catalogq."""
