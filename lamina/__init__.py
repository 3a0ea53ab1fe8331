"""Lamina: versioned key-value tables, log recovery and replicated-log analytics on Spark."""
