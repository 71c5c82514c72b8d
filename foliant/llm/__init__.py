"""Operators for preparing training text: search, near-copies, quality, packing, secrets, licences, encoding, language models, archives."""
