"""Source trees, structure extraction, rules and pattern matches as tables."""
