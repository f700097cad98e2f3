"""Operators for preparing training text: mixing, token counts, quality, language, dedup, PII, scoring."""
