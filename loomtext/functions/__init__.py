"""See the package docstring and README for the place of this layer."""
