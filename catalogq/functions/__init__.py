"""functions of catalogq."""
