"""Training-data operators: text, vectors and web pages at corpus scale.

Nothing outside this folder imports it; the rest of the library works without it.
"""
