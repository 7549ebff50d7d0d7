"""Training-data operators: classifiers, deduplication, mixing, tokenisation, media and HTML."""
