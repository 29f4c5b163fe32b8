"""Operators for preparing training text: mixing, search, sharding, rules, tokens, licences, URLs, quality, language, duplicates."""
