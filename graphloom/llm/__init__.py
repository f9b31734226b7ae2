"""Training-data operators: ten components over documents and embeddings.

Nothing else in the package imports this subpackage.  ``graphloom.llm.registry``
lists its queries and SQL.
"""
