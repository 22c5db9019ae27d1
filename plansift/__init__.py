"""plansift: catalogue retrieval and part analytics expressed as Spark DataFrames."""
from plansift.vocab import Vocabulary

__all__ = ["Vocabulary"]
