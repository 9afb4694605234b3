"""Items in microdata: one pass over the tags of a page with a stack of open elements.

An element with ``itemscope`` is an item, and a property of the item around it if it has ``itemprop``. Other properties get their value
from the attribute that their element has for it (``VALUE_OF``), from ``content`` on any element, or from the text inside. Each item becomes a JSON
object as JSON-LD writes it, so that both are read by one mapper. Time is linear in the page: tags that never close, quotes without an end and closing tags
that nothing opened are passed over without looking at the page again.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Which attribute holds the value of an element's property.
VALUE_OF = {"meta": "content", "a": "href", "area": "href", "link": "href", "img": "src", "audio": "src", "video": "src", "source": "src", "track": "src", "iframe": "src", "embed": "src", "object": "data", "data": "value", "meter": "value", "time": "datetime"}
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that end where the next of their kind begins.
ONE_AFTER_ANOTHER = frozenset("p li td th tr dd dt option".split())
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = re.compile(r"(script|style)(?![A-Za-z0-9-])", re.I)
_END_SCRIPT, _END_STYLE = re.compile("</script", re.I), re.compile("</style", re.I)
_SPACE = re.compile(r"\s+")


@dataclass
class Element:
    """An open element: its item, or the property of ``owner`` that waits for the text gathered since ``since``."""

    name: str
    item: dict | None = None
    owner: dict | None = None
    names: list[str] = field(default_factory=list)
    since: int = 0


def tags(page: str):
    """(start, end, inside) of each tag; comments and declarations are left out, quoted ends do not count."""
    ends = {q: page.rfind(q) for q in "\"'"}
    last_comment = page.rfind("-->")
    at = page.find("<")
    while at >= 0:
        if page.startswith("<!--", at):
            if last_comment < at + 4:
                return
            at = page.find("<", page.find("-->", at + 4) + 3)
            continue
        k = at + 1
        while (m := _STOP.search(page, k)) and m[0] != ">":
            k = page.find(m[0], m.end()) + 1 if ends[m[0]] > m.start() else m.end()
        if not m:
            return
        inside = page[at + 1 : m.start()]
        if inside[:1] not in ("!", "?"):
            yield at, m.end(), inside
        raw = _RAW.match(inside)
        if raw:  # what such an element holds has no tags
            end = (_END_SCRIPT if raw[1].lower() == "script" else _END_STYLE).search(page, m.end())
            if not end:
                return
            at = end.start()
            continue
        at = page.find("<", m.end())


def put(item: dict, names: list[str], value) -> None:
    for n in names:
        item[n] = value if n not in item else [*(item[n] if isinstance(item[n], list) else [item[n]]), value]


def microdata(page: str) -> list[dict]:
    """The items of a page that are no property of another."""
    top: list[dict] = []
    stack: list[Element] = []
    open_names: Counter = Counter()
    scopes: list[dict] = []
    text: list[str] = []  # what stands between tags, so that no text is taken from the page twice
    behind, skip = 0, ""

    def close(e: Element) -> None:
        open_names[e.name] -= 1
        if e.item is not None:
            scopes.pop()
        elif e.names:
            put(e.owner, e.names, _SPACE.sub(" ", entities.unescape("".join(text[e.since :]))).strip())

    for start, end, inside in tags(page):
        name = inside[1:].strip().lower() if inside.startswith("/") else inside.split(None, 1)[0].rstrip("/").lower() if inside.strip() else ""
        if skip:
            if inside.startswith("/") and name == skip:
                skip, behind = "", end
            continue
        text.append(page[behind:start])
        behind = end
        if inside.startswith("/"):
            if name in ("br", "p", "div", "td", "li"):
                text.append(" ")
            if open_names[name] > 0:
                while True:
                    e = stack.pop()
                    close(e)
                    if e.name == name:
                        break
            continue
        if not name:
            continue
        if name in ("script", "style"):
            skip = name
            continue
        if name == "br":
            text.append(" ")
        if name in ONE_AFTER_ANOTHER and stack and stack[-1].name == name:
            close(stack.pop())
        e = Element(name)
        rest = inside[len(name) :]
        if "item" in rest.lower():
            given: dict[str, str] = {}
            for m in _ATTRIBUTE.finditer(rest):
                given.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
            names = given.get("itemprop", "").split()
            if "itemscope" in given:
                e.item = {"@type": given["itemtype"].split()} if given.get("itemtype", "").strip() else {}
                if names and scopes:
                    put(scopes[-1], names, e.item)
                else:
                    top.append(e.item)
            elif names and scopes:
                value = given.get(VALUE_OF.get(name, "content"), given.get("content"))
                if value is not None:
                    put(scopes[-1], names, value)
                elif name not in VOID:
                    e.owner, e.names, e.since = scopes[-1], names, len(text)
        if name in VOID or inside.rstrip().endswith("/"):
            continue
        if e.item is not None:
            scopes.append(e.item)
        stack.append(e)
        open_names[name] += 1
    text.append(page[behind:] if not skip else "")
    for e in reversed(stack):
        close(e)
    return top


@F.pandas_udf(ArrayType(StringType()))
def _items(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: [json.dumps(i, ensure_ascii=False) for i in microdata(p)] if p else [])


def items(page: Column) -> Column:
    """The items of a page as JSON strings; only pages that have any go to Python."""
    return F.coalesce(_items(F.when(F.lower(page).contains("itemscope"), page)), F.array().cast("array<string>"))
