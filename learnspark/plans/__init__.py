"""plans of learnspark."""
