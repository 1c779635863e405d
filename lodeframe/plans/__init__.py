"""Query plans: text to syntax tree to DataFrame."""
