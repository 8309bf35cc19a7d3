"""Query trees, coordinates and their serialized forms."""
