"""All queries of the subpackage, with their SQL where SQL can express them."""

from larder.llm import (  # noqa: F401
    alignment, ball_tree, best_fit, decontaminate, dedup, packing, quality, simhash, substring, token_files, toxicity, urls, warc)
from larder.llm.base import ORACLE, QUERIES  # noqa: F401
