"""Training-data operators: sharding, packing, media, PII, pieces, dedup, toxicity, chat, joins, language."""
