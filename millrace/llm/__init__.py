"""Training-data operators: search, deduplication, mixing, extraction, media,
token output, quality scoring and packing.  Nothing outside this subpackage
imports it."""
