"""Part of the accessibility engine."""
