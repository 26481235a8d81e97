"""Training-data operators: mixing, scoring, cleaning, tokenising, packing and deduplicating documents."""
