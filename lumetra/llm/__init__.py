"""Training-data operators: ten components over documents, embeddings and conversations.

Nothing else in the library imports this subpackage. ``registry`` lists its queries.
"""
