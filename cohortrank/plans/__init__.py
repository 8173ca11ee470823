"""User-facing pipelines (Q1-Q10) built from the operators."""
