"""Record inspection and training-text preparation on Spark."""
