"""Run settings, all passed as arguments; nothing here is read from globals."""

from __future__ import annotations

import math
from dataclasses import dataclass

# The four special tokens, the word-boundary mark, and the training defaults.
UNK = "<unk>"
BOS = "<s>"
EOS = "</s>"
PAD = "<pad>"
SPECIAL_TOKENS = (UNK, BOS, EOS, PAD)
WORD_MARK = "▁"
VOCAB_SIZE = 52_000
MIN_FREQUENCY = 5
LIMIT_ALPHABET = 500
IGNORED_LABEL = -100

FORWARD = "forward"
REVERSED = "reversed"


@dataclass(frozen=True)
class VocabConfig:
    """Vocabulary training: size cap, lowest pair count that may merge, alphabet size cap."""

    vocab_size: int = VOCAB_SIZE
    min_frequency: int = MIN_FREQUENCY
    limit_alphabet: int = LIMIT_ALPHABET


@dataclass(frozen=True)
class BatchConfig:
    """Batch layout of a training run."""

    per_device: int = 5
    devices: int = 2
    accumulation: int | None = None
    target_sequences: int = 32

    @property
    def accumulation_steps(self) -> int:
        """Gradient accumulation; unless given, enough to reach about ``target_sequences`` on two devices."""
        if self.accumulation is not None:
            return self.accumulation
        return math.ceil(self.target_sequences / self.per_device / 2)

    @property
    def global_batch(self) -> int:
        return self.per_device * self.devices * self.accumulation_steps
