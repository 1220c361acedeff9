"""Code-base and asset-corpus intelligence as Spark jobs."""
