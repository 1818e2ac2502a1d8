"""Customer-satisfaction and order-fulfilment analytics as Spark DataFrame jobs."""
