"""Errors of this library: one base, bad input, and iterations that don't settle."""


class QuillonError(Exception):
    pass


class InvalidArgument(QuillonError, ValueError):
    pass


class DidNotConverge(QuillonError, RuntimeError):
    pass


def require(ok: bool, message: str) -> None:
    if not ok:
        raise InvalidArgument(message)
