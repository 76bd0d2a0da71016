"""Language-level (A1..C2) grading of words and texts as Spark DataFrame jobs."""
