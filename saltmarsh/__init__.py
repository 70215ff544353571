"""saltmarsh: transcript scoring and corpus operators as Spark jobs."""
