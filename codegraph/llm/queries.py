"""Registry of the corpus queries."""

from . import decontaminate, html, langid, media, mixing, neardup, periodic, quality, rowmatch, substring, suffixdedup, vectordup, warc

QUERIES: dict = {}
ORACLE: dict = {}
for _module in (decontaminate, langid, media, quality, neardup, substring, html, warc, suffixdedup, mixing, periodic, vectordup, rowmatch):
    QUERIES |= _module.QUERIES
    ORACLE |= getattr(_module, "ORACLE", {})
