"""garbline: workwear supply-chain analytics as Spark DataFrame operators."""
