"""Text analysis and typed attribute search over native columns."""
