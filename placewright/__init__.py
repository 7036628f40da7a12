"""placewright: place data on Spark - catalog cleaning, place search, message planning, evaluation and streaming limits."""
