"""Training-data operators: near-dedup, token files, quality, language, mixing, search, URL rules, chat and media."""
