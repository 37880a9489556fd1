"""lexforge plans."""
