"""HTML made inert, and titles.

A rewrite by regular expressions is not safe, so pages go through the standard parser in a pandas
UDF.  The parser only lists markup events; what to leave out and how to print the rest are tables
over that list.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partialmethod
from html import escape, unescape
from html.parser import HTMLParser
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements dropped with all they hold, elements without an end, attributes with URLs,
#: schemes that run code or hold data.
DROPPED = ("script", "iframe", "object")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
URL_ATTRIBUTES = ("action", "background", "cite", "formaction", "href", "icon", "longdesc", "manifest", "ping", "poster", "src", "srcset", "usemap", "xlink:href")
UNSAFE_SCHEMES = ("javascript:", "data:")


class Event(NamedTuple):
    """An opening, a closed opening (``alone``), a closing, or text; the name of text is the text."""

    kind: str
    name: str
    attributes: tuple[tuple[str, str | None], ...] = ()


class _Listed(HTMLParser):
    """The events of a page; comments, declarations and instructions are none."""

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.events: list[Event] = []
        self.feed(page)
        self.close()

    def _add(self, kind: str, name: str, attributes: list[tuple[str, str | None]] | tuple = ()) -> None:
        self.events.append(Event(kind, name, tuple((k.lower(), v) for k, v in attributes)))

    handle_starttag = partialmethod(_add, "open")
    handle_startendtag = partialmethod(_add, "alone")
    handle_endtag = partialmethod(_add, "close")
    handle_data = partialmethod(_add, "text")


def _squeezed(value: str | None, signs: str = "") -> str:
    """A value as a browser reads it: unescaped, lower case, without blanks, controls and ``signs``."""
    return "".join(c for c in unescape(value or "").lower() if c > " " and c not in signs)


def _unsafe_url(value: str | None) -> bool:
    return value is None or _squeezed(value).startswith(UNSAFE_SCHEMES)


def _unsafe_set(value: str | None) -> bool:
    return value is None or any(part.startswith(UNSAFE_SCHEMES) for part in _squeezed(value).split(","))


def _unsafe_style(value: str | None) -> bool:
    return any(part.startswith(UNSAFE_SCHEMES) for part in _squeezed(value, "'\"").split("url(")[1:])


#: Judges of attribute values by name; names that are not listed are harmless.
_JUDGES: dict[str, Callable[[str | None], bool]] = dict.fromkeys(URL_ATTRIBUTES, _unsafe_url) | {"srcset": _unsafe_set, "style": _unsafe_style}


def unsafe_attribute(name: str, value: str | None) -> bool:
    """Whether an attribute can run code or load data in place; handlers always can."""
    return name[:2] == "on" or (name in _JUDGES and _JUDGES[name](value))


def _tag(e: Event) -> str:
    kept = (escape(k) + ("" if v is None else f'="{escape(v)}"') for k, v in e.attributes if not unsafe_attribute(k, v))
    return " ".join([e.name, *kept])


_PRINT: dict[str, Callable[[Event], str]] = {
    "open": lambda e: f"<{_tag(e)}>",
    "alone": lambda e: f"<{_tag(e)} />",
    "close": lambda e: "" if e.name in VOID else f"</{e.name}>",
    "text": lambda e: escape(e.name, quote=False),
}
#: How far an event of a dropped element leads into it.
_STEP = {"open": 1, "alone": 0, "close": -1}


def inert(page: str | None) -> str | None:
    """One page without anything that runs: scripts, frames, objects, handlers, comments, declarations."""
    if page is None:
        return None
    events = _Listed(page).events
    dropped = [e.kind != "text" and e.name in DROPPED for e in events]
    depth = accumulate((_STEP[e.kind] if d else 0 for e, d in zip(events, dropped, strict=True)), lambda at, step: max(at + step, 0), initial=0)
    # an event stands outside if nothing is open before it and it opens nothing; a stray end of a dropped element is printed
    return "".join(_PRINT[e.kind](e) for e, d, before in zip(events, dropped, depth, strict=False) if not before and (not d or e.kind == "close"))


def title(page: str | None) -> str | None:
    """The text of a page's titles, or None."""
    events = _Listed(page or "").events
    turn = (e.kind if e.kind in ("open", "close") and e.name == "title" else "" for e in events)
    within = accumulate(turn, lambda now, new: {"open": True, "close": False}.get(new, now), initial=False)
    return " ".join(" ".join(e.name for e, now in zip(events, within, strict=False) if now and e.kind == "text").split()) or None


@F.pandas_udf(T.StringType())
def sanitize_html(pages: pd.Series) -> pd.Series:
    return pages.map(inert)


@F.pandas_udf(T.StringType())
def html_title(pages: pd.Series) -> pd.Series:
    return pages.map(title)
