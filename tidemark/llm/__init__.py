"""Training-data operators on document tables (``doc_id``, ``text``, ``lang``, ``source``).

Shared rules: an operator selects the columns it names and ignores every other column, so extra
or clashing columns do no harm; a null text counts as an empty one unless stated; an empty table
gives an empty result of the same schema. Nothing outside this package imports it.
"""
