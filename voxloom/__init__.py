"""Speech-timeline and translation-QA analytics as Spark DataFrame jobs."""
