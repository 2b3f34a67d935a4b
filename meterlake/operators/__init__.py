"""DataFrame transforms: lazily composed, nothing collected."""
