"""streaming of learnspark."""
