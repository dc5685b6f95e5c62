"""Column functions: numbers, dates, text and the rule tables."""
