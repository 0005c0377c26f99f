"""Transaction-risk analytics as Spark jobs: every operator takes and returns a DataFrame."""
