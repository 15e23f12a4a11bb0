"""Instance analytics and corpus building on Spark."""
