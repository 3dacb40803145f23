"""Training-data operators.

One module per operator.  Nothing outside this subpackage imports it; the
registry module :mod:`auditlens.llm.registry` lists its queries.
"""
