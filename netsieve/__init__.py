"""Open-set network-traffic analytics expressed as Spark DataFrame jobs."""
