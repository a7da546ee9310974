"""Analytics on panels of daily bars, and on text corpora, with Spark."""
