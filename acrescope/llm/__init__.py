"""Training-data operators over documents, embeddings and page urls."""
