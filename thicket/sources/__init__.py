"""Where components come from."""
