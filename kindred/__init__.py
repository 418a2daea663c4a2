"""kindred: entity resolution and training-data operators expressed as Spark DataFrame plans."""
