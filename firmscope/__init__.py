"""Company-market analytics as Spark DataFrame plans."""
