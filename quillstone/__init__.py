"""Analytics over identity-addressed state, written as Spark jobs."""
