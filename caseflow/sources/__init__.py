"""Reading and writing request records."""
