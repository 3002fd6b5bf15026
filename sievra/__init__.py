"""sievra: data-quality profiling, repair and corpus processing as Spark plans."""
