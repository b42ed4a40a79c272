"""Training-data operators: ten operators over documents, pages and conversations."""
