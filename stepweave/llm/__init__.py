"""Training-data operators: mixing, licences, search, tokenizers, toxicity, sharding and deduplication."""
