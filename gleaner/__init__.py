"""gleaner: research-corpus analytics as Spark DataFrame jobs."""
