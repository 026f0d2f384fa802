"""Training-data operators: quality, mixing, toxicity, deduplication, archives, decontamination, chat, tokens, language.

Nothing outside this subpackage imports it.
"""
