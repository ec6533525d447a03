"""Part of tarnwatch."""
