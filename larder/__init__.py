"""Recipe documents from web pages as Spark plans: extraction, merging, line parsing, display, storage and evaluation."""
