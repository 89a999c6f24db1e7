"""Building blocks for plans that stay balanced on skewed data."""
