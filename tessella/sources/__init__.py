"""Reading corpora and vocabularies; keeping results and checkpoints as tables."""
