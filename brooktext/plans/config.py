"""Settings of a scoring run."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    """The defaults of the training loop that the scoring serves. `sampling` is handed to a model step as it is."""

    batch_size: int = 2
    epochs: int = 4
    log_every: int = 1
    save_every: int = 50
    flush_every: int = 50
    prompt_tokens: int = 512
    sampling: dict = field(default_factory=lambda: {"max_new_tokens": 512, "min_length": -1, "temperature": 0.7, "top_k": 0.0, "top_p": 1.0})
