"""Elements of a page from its tags in a row: one pass that counts the depth of what is open.

An element ends at the end tag that balances it among the tags of its name, or at the
end of the page; so boxes inside boxes are told apart, which a pattern cannot do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

# Elements and class or id words whose content is no article text.
REMOVED_ELEMENTS = ("script", "style", "noscript", "iframe", "nav", "header", "footer", "aside", "form")
REMOVED_CLASSES = ("advert", "banner", "social", "related", "recommend", "share")
REMOVED_IDS = ("related", "advert")
REMOVED_EXACT_CLASSES = ("ad", "ads")
# Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Elements whose content holds no tags, and those of which a browser shows nothing.
RAW = frozenset(("script", "style"))
UNSEEN = frozenset(("script", "style", "noscript", "template"))
BODIES = ("article", "main")

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"""(?i)(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Begin, end, name (empty for a comment), whether it closes, attributes. What stands in scripts is skipped."""
    raw, at = None, 0
    while tag := TAG.search(page, at):
        name, closing = (tag[2] or "").lower(), tag[1] == "/"
        at = tag.end()
        if raw and not (closing and name == raw):
            at = tag.start() + 1
            continue
        raw = name if name in RAW and not closing else None
        yield tag.start(), tag.end(), name, closing, tag[3] or ""


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in reversed(list(ATTRIBUTE.finditer(text)))} if "=" in text else {}


def is_noise(name: str, text: str) -> bool:
    if name in REMOVED_ELEMENTS:
        return True
    held = attributes(text)
    classes, own_id = held.get("class", "").lower(), held.get("id", "").lower()
    return (
        any(w in classes for w in REMOVED_CLASSES)
        or any(w in own_id for w in REMOVED_IDS)
        or any(w in REMOVED_EXACT_CLASSES for w in classes.split())
    )


def without_noise(page: str) -> str:
    """The page with a blank in place of every comment and every removed element, its content included."""
    kept, at = [], 0
    name, depth = None, 0
    for begin, end, tag, closing, text in tags(page):
        if name is None:
            if tag and (closing or not is_noise(tag, text)):
                continue
            kept += [page[at:begin], " "]
            at = end
            if tag and tag not in VOID:
                name, depth = tag, 1
        elif tag == name:
            depth += -1 if closing else 1
            if depth == 0:
                name, at = None, end
    return "".join(kept) if name else "".join([*kept, page[at:]])


class _Bodies:
    """What the pass over a page collects."""

    def __init__(self) -> None:
        self.paragraphs: dict[str, list[str]] = {k: [] for k in (*BODIES, "role")}
        self.whole: dict[str, list[str]] = {k: [] for k in self.paragraphs}
        self.done: set[str] = set()
        self.open = dict.fromkeys(BODIES, 0)
        self.role: tuple[str, int] | None = None
        self.unseen: tuple[str, int] | None = None
        self.paragraph: tuple[list[str], list[str]] | None = None

    def inside(self) -> list[str]:
        return [b for b in BODIES if self.open[b] > 0] + (["role"] if self.role else [])

    def text(self, piece: str) -> None:
        if self.unseen or not piece:
            return
        if self.paragraph:
            self.paragraph[0].append(piece)
        for body in self.inside():
            if body not in self.done:
                self.whole[body].append(piece)

    def end_paragraph(self) -> None:
        if self.paragraph:
            pieces, bodies = self.paragraph
            for body in bodies:
                self.paragraphs[body].append("".join(pieces))
        self.paragraph = None

    def tag(self, name: str, closing: bool, text: str) -> None:
        step = -1 if closing else 1
        if self.unseen:
            if name == self.unseen[0]:
                self.unseen = (name, self.unseen[1] + step) if self.unseen[1] + step else None
            return
        if name in UNSEEN and not closing:
            self.unseen = (name, 1)
            return
        if name == "br":
            self.text(" ")
        elif name == "p":
            self.end_paragraph()
        if name in BODIES:
            self.end_paragraph()
            self.open[name] += step
            if self.open[name] == 0:
                self.done.add(name)
        if self.role and name == self.role[0]:
            self.role = (name, self.role[1] + step)
            if self.role[1] == 0:
                self.end_paragraph()
                self.role = None
                self.done.add("role")
        elif not self.role and not closing and name not in VOID and attributes(text).get("role") == "main":
            self.end_paragraph()
            self.role = (name, 1)
        if name == "p" and not closing:
            self.paragraph = ([], self.inside())


def bodies(page: str) -> tuple[list[str], str | None]:
    """Texts of the paragraphs in articles, then in main elements, then in elements of that role; and the first such element's whole text."""
    found, at = _Bodies(), 0
    for begin, end, name, closing, text in tags(page):
        found.text(page[at:begin])
        at = end
        if name:
            found.tag(name, closing, text)
    found.text(page[at:])
    found.end_paragraph()
    wholes = ["".join(pieces) for pieces in found.whole.values()]
    return [p for own in found.paragraphs.values() for p in own], next((w for w in wholes if w.strip()), None)


def remove_noise(page: Column) -> Column:
    """Pages without comments and removed elements."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda page: without_noise(page) if isinstance(page, str) else None)

    return F.pandas_udf(run, "string")(page)


def page_bodies(page: Column) -> Column:
    """Struct of paragraphs and body, see :func:`bodies`; both empty for null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([bodies(page) if isinstance(page, str) else ([], None) for page in batch], columns=["paragraphs", "body"])

    return F.pandas_udf(run, "paragraphs array<string>, body string")(page)
