"""Index building, retrieval, evaluation and statistics, as DataFrame plans."""
