"""Plan-time settings. They are constants of a plan, never columns. Their defaults are FIXED VALUES, as they decide results."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

#: What a task's profile sets over a user's own settings; None: the text must stay as it is.
PROFILES = {
    "transformer": {"stemming": False, "remove_stopwords": False, "lemmatization": False, "min_token_length": 1, "collapse_repeated_words": False},
    "bag_of_words": {"stemming": True, "remove_stopwords": True, "min_token_length": 2, "collapse_repeated_words": True},
    "span": None,
}


@dataclass(frozen=True)
class CleanConfig:
    case_folding: bool = True
    remove_punctuation: bool = True
    remove_numbers: bool = False
    remove_stopwords: bool = True
    stemming: bool = True
    lemmatization: bool = False  # accepted and without effect
    custom_stopwords: tuple[str, ...] = ()
    min_token_length: int = 2
    collapse_repeated_words: bool = True
    fix_typos: bool = True
    normalize_slang: bool = True
    protect_negation: bool = True

    @staticmethod
    def for_task(task: str, user: dict | None = None) -> CleanConfig | None:
        """User settings, then the profile over them. None for a task whose text must not change; unknown tasks raise."""
        if task not in PROFILES:
            raise ValueError(f"unknown task {task!r}; known: {', '.join(PROFILES)}")
        if PROFILES[task] is None:
            return None
        own = dict(user or {})
        if "custom_stopwords" in own:
            own["custom_stopwords"] = tuple(own["custom_stopwords"])
        return replace(CleanConfig(**own), **PROFILES[task])


@dataclass(frozen=True)
class SentimentConfig:
    temperature: float = 2.7748
    review_threshold: float = 0.94
    review_limit: int = 200
    max_tokens: int = 512

    def __post_init__(self):
        if not 0.05 < self.temperature < 20:
            raise ValueError("temperature must be in (0.05, 20)")


@dataclass(frozen=True)
class TopicConfig:
    top_words: int = 10
    seed: int = 42
    outlier_similarity: float = 0.10
    min_topics: int = 4
    max_share: float = 0.5
    max_share_times_k: float = 3.5
    degenerate_min: int = 3
    degenerate_cap: int = 8
    docs_per_topic: int = 250
    min_token_freq: int = 1
    min_label_freq: int = 1
    label_diversity: float = 0.3
    #: Share of a cluster's documents, those farthest from its centre, that are outliers until pull_outliers takes them back.
    outlier_share: float = 0.05


@dataclass(frozen=True)
class Lexicon:
    """Dictionaries of a language; every operator takes its own, with the Indonesian ones as defaults."""

    slang: dict[str, str] = field(default_factory=dict)
    typos: dict[str, str] = field(default_factory=dict)
    stopwords: frozenset[str] = frozenset()
    negations: frozenset[str] = frozenset()
    positive: frozenset[str] = frozenset()
    negative: frozenset[str] = frozenset()
    lexicon_negations: frozenset[str] = frozenset()
    roots: frozenset[str] = frozenset()
