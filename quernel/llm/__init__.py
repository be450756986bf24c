"""Training-data operators: ten large-scale text and embedding operations.

Nothing outside this subpackage imports it; it can be deleted as a whole.
"""
