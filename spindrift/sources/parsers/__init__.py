"""Parsers: source text to symbol, relationship and import rows, one registry entry for each language."""
