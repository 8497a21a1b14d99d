"""Training-data operators: deduplication, language, mixing, packing, scans, media, privacy and URL filters."""
