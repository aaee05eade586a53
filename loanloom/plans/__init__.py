"""Multi-stage jobs built from the operators."""
