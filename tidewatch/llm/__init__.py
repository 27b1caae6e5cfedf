"""Training-data operators: DataFrame-in, DataFrame-out operators for text, vectors and chats.

Nothing outside this subpackage imports it.
"""
