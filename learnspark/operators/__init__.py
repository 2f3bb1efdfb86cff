"""operators of learnspark."""
