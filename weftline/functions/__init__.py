"""Column functions: text, prompts and metrics."""
