"""Column expressions: text, scores, ages and record parsing."""
