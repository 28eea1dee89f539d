"""Training-data operators: deduplication, filters, tokenizing, packing, chat formatting and language models."""
