"""Training-data operators: privacy, packing, near duplicates, mixing, quality, media, secrets, chat, repeats."""
