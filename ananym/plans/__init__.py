"""The jobs from corpus to batches, put together from the operators."""

from ananym.plans.jobs import prepare_corpus, tokenise_corpus, train_tokenizer, training_batches

__all__ = ["prepare_corpus", "tokenise_corpus", "train_tokenizer", "training_batches"]
