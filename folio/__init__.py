"""A document analytics engine over a relational projection of structured documents, native to Spark."""
