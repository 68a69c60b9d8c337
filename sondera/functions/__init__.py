"""Column expressions and scalar helpers; no Python UDFs in here."""
