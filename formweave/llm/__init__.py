"""Training-data operators: scans, mixing, language id, packing, search, quality, PII, chat, deduplication."""
