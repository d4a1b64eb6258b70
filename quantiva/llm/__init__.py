"""Training-data operators: archives, near duplicates, search, language and quality models, tokenizers."""
