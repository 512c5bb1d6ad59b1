"""Training-data operators: filtering, de-duplication, search, counting and
packing of text at corpus scale.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; ``queries`` holds the thin
``opN_<name>`` queries that apply them to whole tables.
"""
