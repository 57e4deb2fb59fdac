"""Document folds as Structured Streaming."""
