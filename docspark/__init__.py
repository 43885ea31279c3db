"""Document-reference analytics as Spark DataFrame and Column functions."""
