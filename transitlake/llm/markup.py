"""Where the tags of a page are: one pass, in linear time, with comments, declarations, quotes and raw contents respected."""

from __future__ import annotations

import re
from collections.abc import Iterator

_OPENS = re.compile(r"<(?:(!--)|([!?]|/[^a-zA-Z])|(/?)([a-zA-Z][^\s/>]*))")
_REST_OF_TAG = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+>")
_SHORT, _CLOSE, _END_OF_COMMENT = re.compile("-?>"), re.compile(">"), re.compile("--!?>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")


def constructs(html: str, raw: frozenset[str]) -> Iterator[tuple[int, int, str]]:
    """(start, end, name) of what isn't text: tags by name, with a slash before that of an end tag; an empty name for
    comments, declarations and elements of ``raw`` with all they hold. An unfinished one reaches to the page's end."""
    at = 0
    while (m := _OPENS.search(html, at)) is not None:
        name = (m[3] + m[4].lower()) if m[4] else ""
        if m[1]:
            end = _SHORT.match(html, m.end()) or _END_OF_COMMENT.search(html, m.end())  # <!--> and <!---> are whole
        elif m[2]:
            end = _CLOSE.search(html, m.end() - 1)
        else:
            end = _REST_OF_TAG.match(html, m.end())
        if end and name in raw:
            closing = re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE).search(html, end.end())
            end, name = closing and _REST_OF_TAG.match(html, closing.end()), ""
        at = end.end() if end else len(html)
        yield m.start(), at, name if end else ""


def attributes(tag: str) -> dict[str, str]:
    """Attributes of a start tag by lower-case name; of two with one name the first counts."""
    out: dict[str, str] = {}
    name = _OPENS.match(tag)
    for m in _ATTRIBUTE.finditer(tag, name.end() if name else 0, len(tag) - 1):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out
