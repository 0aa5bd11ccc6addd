"""Training-data operators: text tokenisation, cleaning, deduplication, packing and vector search on Spark."""
