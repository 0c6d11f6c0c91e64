"""Complete queries out of operators, and declarative pipelines."""
