"""Delay-risk analytics as composable Spark DataFrame operators."""
