"""All queries of this folder and their SQL twins."""

from pagetables.llm import classlm, codebooks, collocations, decontaminate, extract, language, near, packing, pii, quality, repeats, sharding, urlrules  # noqa: F401
from pagetables.llm.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
