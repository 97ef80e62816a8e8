"""Training-data operators: ten stages a corpus passes on its way to a model.

Nothing outside this package imports it; its queries are listed in
``papyra.llm.queries``.
"""
