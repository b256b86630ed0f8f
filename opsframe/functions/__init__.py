"""Column expressions: text, prices, scores and monitoring rules."""
