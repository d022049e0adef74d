"""Operators for preparing text corpora and their metadata; nothing else in catalogq imports this subpackage."""
