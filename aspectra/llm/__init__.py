"""Training-data operators: ten distributed operators for large text corpora.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; :mod:`aspectra.llm.queries` derives the registered
``opN_*`` queries from them.
"""
