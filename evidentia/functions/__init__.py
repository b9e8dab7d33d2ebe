"""Column functions: text, numbers and plane geometry."""
