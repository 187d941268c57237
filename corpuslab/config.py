"""Settings of the text operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PreprocessConfig:
    """Switches of ``preprocess_text``; ``remove_punctuation`` has no effect of its own, as only words are kept."""

    lowercase: bool = True
    remove_stopwords: bool = True
    lemmatize: bool = True
    allowed_pos: frozenset[str] | None = None
    min_word_length: int = 2
    remove_numbers: bool = False
    remove_punctuation: bool = True
    remove_short_sentences: bool = False
    normalize_hyphens: bool = True
    min_alpha_ratio: float = 0.5
    remove_single_chars: bool = True
    normalize_contractions: bool = True

    def __post_init__(self) -> None:
        if self.allowed_pos is not None:
            object.__setattr__(self, "allowed_pos", frozenset(p.upper() for p in self.allowed_pos))


#: The plain defaults, and what the topic and masking stages use.
DEFAULT = PreprocessConfig()
PIPELINE = PreprocessConfig(min_word_length=3, min_alpha_ratio=0.7, remove_numbers=True)
