"""cohortlens: compare two groups of prompts and the responses they get, on Spark."""
