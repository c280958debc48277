"""Court-ruling analytics on Spark."""

import os


def has_llm() -> bool:
    """Whether the optional training-data package lies beside this one."""
    here = os.path.dirname(os.path.abspath(__file__))
    return os.path.exists(os.path.join(here, "llm", "registry.py")) and os.path.exists(os.path.join(os.path.dirname(here), "corpus_pipeline.py"))
