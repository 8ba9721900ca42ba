"""parsing."""
