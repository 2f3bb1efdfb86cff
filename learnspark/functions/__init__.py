"""functions of learnspark."""
