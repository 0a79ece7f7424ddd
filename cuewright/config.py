"""Settings: detection modes, encoder presets, prompts of vision-language models."""

from __future__ import annotations

from dataclasses import dataclass, replace

from cuewright import rules


@dataclass(frozen=True)
class Detection:
    """How cuts are found: adaptive or by content, with a fade threshold; whether similar neighbours are merged."""

    adaptive: bool = True
    fades: bool = False
    threshold: float = 12.0
    merge_similar: bool = False
    similar: float = 0.85
    ratio: float = 3.0
    least: float = 15.0
    window: int = 2
    min_len: int = 15


# The modes; an unknown one is ``adaptive``.
MODES = {
    "adaptive": Detection(),
    "static": Detection(adaptive=False, fades=True, threshold=16.0),
    "dynamic": Detection(fades=True, merge_similar=True),
}


def detection(mode: str = "adaptive", threshold: float | None = None, auto: bool | None = None, merge_similar: bool = False) -> Detection:
    """A mode with its overrides: another threshold, or adaptive (``auto`` true) or content detection (false)."""
    d = MODES.get(mode, MODES["adaptive"])
    if threshold is not None:
        d = replace(d, threshold=float(threshold))
    if auto is not None:
        d = replace(d, adaptive=auto, fades=not auto or d.fades)
    return replace(d, merge_similar=d.merge_similar or merge_similar)


@dataclass(frozen=True)
class Encoder:
    """An audio and text encoder: its architecture, and whether long sounds are fused from parts."""

    architecture: str
    fusion: bool


# The presets that an index can be made with.
ENCODERS = {
    "natural": Encoder("HTSAT-tiny", True),
    "natural_fast": Encoder("HTSAT-tiny", False),
    "music": Encoder("HTSAT-base", False),
    "music_speech": Encoder("HTSAT-base", False),
}


def tag_limit(value: int | None = None) -> int:
    """The number of tags a scene keeps; fewer than 3 can't be asked for."""
    return value if value is not None and value >= 3 else 10


def text_weight(asked: float, has_text: bool) -> float:
    """The weight of text similarity that a report shows: none without text vectors."""
    return asked if has_text else 0.0


def scene_prompt(categories: list[str] | None = None) -> str:
    """Asks for the two lines that ``functions.text.parse_reply`` reads."""
    names = ", ".join(categories or rules.PROMPT_CATEGORIES)
    return f"Say what this picture would sound like, in exactly two lines.\nCATEGORY: one of {names}\nDESCRIPTION: the audible sounds only, in ten to fifteen plain words"


def contrast_prompt() -> str:
    """Asks for the two lines that ``functions.text.line_categories`` and ``labelled_line`` read."""
    names = "\n".join(f"{key} - {entry[3]}" for key, entry in rules.VOCABULARY.items())
    return f"Choose the category of this scene and one that is opposed to it, from:\n{names}\n\nAnswer in two lines.\nPOSITIVE: CATEGORY - time - perspective - sounds\nNEGATIVE: CATEGORY - time - perspective - sounds"
