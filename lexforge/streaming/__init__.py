"""lexforge streaming."""
