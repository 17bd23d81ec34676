"""Training-data operators: dedup, language, tokens, chat, decontamination, mixing, quality, HTML."""
