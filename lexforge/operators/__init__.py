"""lexforge operators."""
