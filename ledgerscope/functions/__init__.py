"""Column expressions: text, dates, numbers, bands and labels."""
