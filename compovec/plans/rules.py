"""Keyword rules used by the example queries: letter patterns per domain, built from a rule."""

from __future__ import annotations

from compovec.operators.rules import RuleSet
from compovec.sources import ontology

SYLLABLES = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha",
             "at", "en", "es", "or", "nt", "ea", "ti", "to", "it", "st")


def example_rules() -> RuleSet:
    """Domain ``i`` is spotted by syllable ``i`` in three contexts and put off by one."""
    n = len(SYLLABLES)
    keywords, negative = {}, {}
    for i, domain in enumerate(ontology.ids()):
        s, nxt, far, off = (SYLLABLES[(i + k) % n] for k in (0, 1, 4, 7))
        keywords[domain] = [(s + nxt, 2.0), (s + "[a-z]?" + far, 1.0), ("(^| )" + s + "[ ,.]", 1.0)]
        negative[domain] = [(off + s, -1.0)]
    # later domains first: ties are decided by an order unlike the tree order
    return RuleSet(keywords, negative, priority=list(reversed(ontology.ids())))
