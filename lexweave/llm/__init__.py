"""Training-data operators: filtering, deduplication, search, extraction, mixing, packing and archives.

Nothing else in the library imports this subpackage.  Each module holds one operator with a general
interface; `lexweave.llm.queries` derives the registered queries from them.
"""
