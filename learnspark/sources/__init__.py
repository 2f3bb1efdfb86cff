"""sources of learnspark."""
