"""Typed errors with stable codes [X07]."""

from __future__ import annotations


class QuireError(Exception):
    code = "error"


class OptionError(QuireError):
    code = "invalid-option"


class LimitError(QuireError):
    code = "limit"


class MissingLibraryError(QuireError):
    code = "missing-library"


class InvalidBookError(QuireError):
    code = "invalid-book"


class BrokenInputError(QuireError):
    code = "malformed"


class EncryptedError(QuireError):
    code = "encrypted"


class UnreadableError(QuireError):
    code = "io"


class MissingAssetError(QuireError):
    code = "missing-asset"


def check_limit(name: str, value: float, maximum: float) -> None:
    """Raises above a fixed maximum [F19]."""
    if value > maximum:
        raise LimitError(f"{name}: {value} is over {maximum}")


def check_choice(name: str, value: object, allowed: list[object]) -> None:
    """A closed option [F18]."""
    if value not in allowed:
        raise OptionError(f"{name}: {value!r} is not one of {', '.join(map(str, allowed))}")


def page_indices(spec: str | None, pages: int) -> list[int]:
    """0-based pages of a 1-based list like '1-10,15' [F01, O01, U01]; None is all."""
    if pages < 1:
        raise OptionError("no pages")
    if not spec:
        return list(range(pages))
    chosen: set[int] = set()
    for part in filter(None, map(str.strip, spec.split(","))):
        ends = part.split("-", 1)
        try:
            low, high = int(ends[0]), int(ends[-1])
        except ValueError:
            raise OptionError(f"not a page range: {part}") from None
        if not 1 <= low <= high <= pages:
            raise OptionError(f"page range {part} is outside 1-{pages}")
        chosen |= set(range(low - 1, high))
    if not chosen:
        raise OptionError("the page range selects nothing")
    return sorted(chosen)
