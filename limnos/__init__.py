"""Lake land-cover and shoreline-change analytics on Spark."""
