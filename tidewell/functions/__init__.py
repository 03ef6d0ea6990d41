"""See the package docstring of tidewell."""
