"""lexforge sources."""
