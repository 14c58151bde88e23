"""Relational operators of the pipeline: segmentation, extraction, vocabulary, targeting, detection, consolidation, evaluation."""
