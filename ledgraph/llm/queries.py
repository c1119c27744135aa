"""Registered queries and SQL of this subpackage."""

from importlib import import_module

MODULES = ("suffix", "quality", "sentences", "simhash", "lm", "decontaminate", "langid", "mixing", "warc", "toxicity", "chat", "trie", "merkle")
QUERIES, ORACLES = {}, {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
