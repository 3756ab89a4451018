"""Column functions: text shape, timestamps, instrument rules, display text."""
