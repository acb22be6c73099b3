"""Multi-step plans: the two feature tables and the whole chain from source to reports."""
