"""Spark-first analytics for evidence-triage benchmarks."""
