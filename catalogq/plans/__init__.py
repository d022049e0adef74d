"""plans of catalogq."""
