"""Column expressions: text, identity, damage, money, scores, URLs and JSON."""
