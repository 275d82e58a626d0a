"""Column expressions: money, dates, wording, formats and web fields."""
