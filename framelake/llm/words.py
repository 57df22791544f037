"""Small helpers on words, linear in their length."""

from __future__ import annotations


def strip_right(word: str) -> str:
    """word without what is neither letter nor digit at its end."""
    end = len(word)
    while end and not word[end - 1].isalnum():
        end -= 1
    return word[:end]


def strip_marks(word: str) -> str:
    """word without what is neither letter nor digit at both ends."""
    word = strip_right(word)
    at = 0
    while at < len(word) and not word[at].isalnum():
        at += 1
    return word[at:]
