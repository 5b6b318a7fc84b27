"""End-to-end queries: the driver's tables bound to the data model, then the operators."""
