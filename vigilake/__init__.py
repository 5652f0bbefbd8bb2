"""vigilake: security-event analytics on Spark."""
