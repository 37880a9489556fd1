"""lexforge functions."""
