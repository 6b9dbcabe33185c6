"""Table functions over one document: rows of mentions, chunks and marked paragraphs, called with lateral joins.

register() gives them names for SQL: `SELECT d.id, m.* FROM docs d, LATERAL figure_mentions(d.paragraphs) m`. mentions(),
packed_chunks() and marked() call them from DataFrames.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAPTION = 500
MARKS = ":：.．"

# fixed values: mentions of figures and tables, tried in this order: kind, whether it begins a caption, pattern
MENTIONS = (
    ("figure", False, r"(?i)(?:Supplementary|Supp\.?|SI|Extended\s+Data)\s*(?:Figure|Fig\.?)\s*([A-Z]?\d+(?:\.\d+)?)"),
    ("figure", False, r"(?i)(?:Figure|Fig\.?)\s+([A-Z]\d+(?:\.\d+)?)[:\.\s]"),
    ("table", False, r"(?i)(?:Supplementary|Supp\.?|SI|Extended\s+Data)\s*(?:Table)\s*([A-Z]?\d+(?:\.\d+)?)"),
    ("table", False, r"(?i)(?:Table)\s+([A-Z]\d+(?:\.\d+)?)[:\.\s]"),
    ("figure", True, r"(?i)^(?:Figure|Fig\.?)\s+(\d+)([a-z](?:-[a-z])?)[:\.\s]"),
    ("figure", False, r"(?i)\b(?:Figure|Fig\.?)\s+(\d+)([a-z](?:-[a-z])?)\b"),
    ("figure", False, r"(?i)(?:Figure|Fig\.?)s?\s+(\d+)([A-Za-z])\s*[-–—]\s*([A-Za-z])"),
    ("figure", False, r"(?i)(?:Figures?|Figs?\.?)\s+(\d+)\s*(?:to|[-–—])\s*(\d+)"),
    ("table", False, r"(?i)(?:Tables?)\s+(\d+)\s*(?:to|[-–—]|and)\s*(\d+)"),
    ("figure", True, r"(?i)^(?:Figure|Fig\.?)\s+(\d+(?:\.\d+)?)[:\.\s]"),
    ("figure", False, r"(?i)\b(?:Figure|Fig\.?)\s+(\d+(?:\.\d+)?)[:\.\s\)]"),
    ("table", True, r"(?i)^(?:Table)\s+(\d+(?:\.\d+)?)[:\.\s]"),
    ("table", False, r"(?i)\b(?:Table)\s+(\d+(?:\.\d+)?)[:\.\s\)]"),
    ("figure", True, r"(?i)^(?:Scheme|Chart|Diagram|Plate|Panel)\s+(\d+)[:\.\s]"),
    ("figure", True, r"^图\s*(\d+(?:\.\d+)?)[：:．.\s]"),
    ("figure", False, r"图\s*(\d+(?:\.\d+)?)[：:．.\s]"),
    ("figure", False, r"(?i)图\s*(\d+)([a-z])"),
    ("figure", False, r"图\s*(\d+)\s*[－\-–—～~]\s*(\d+)"),
    ("table", True, r"^表\s*(\d+(?:\.\d+)?)[：:．.\s]"),
    ("table", False, r"表\s*(\d+(?:\.\d+)?)[：:．.\s]"),
    ("table", False, r"(?i)表\s*(\d+)([a-z])"),
    ("table", False, r"表\s*(\d+)\s*[－\-–—～~]\s*(\d+)"),
    ("figure", False, r"(?:补充|附加|附)\s*图\s*([A-Za-z]?\d+)"),
    ("table", False, r"(?:补充|附加|附)\s*表\s*([A-Za-z]?\d+)"),
    ("figure", False, r"扩展数据\s*图\s*(\d+)"),
    ("table", False, r"扩展数据\s*表\s*(\d+)"),
    ("figure", False, r"SI\s*图\s*(\d+)"),
    ("table", False, r"SI\s*表\s*(\d+)"),
    ("figure", True, r"^图表\s*(\d+)[：:]"),
    ("figure", False, r"图表\s*(\d+)"),
    ("figure", False, r"(?:插图|示意图|流程图|框架图|原理图)\s*(\d+)"),
    ("figure", False, r"(?:曲线图|柱状图|饼图|散点图|直方图)\s*(\d+)"),
)
# fixed values: words before a mention that only refers
REFERRING = ("see ", "shown in ", "as in ", "refer to ", "参见", "如图", "见表")
# fixed values: what gets a marker, tried in this order
MARKERS = (
    ("FIGURE", r"(?i)(?:Figure|Fig\.?)\s+(\d+)([a-z]?)"),
    ("TABLE", r"(?i)(?:Table)\s+(\d+)([a-z]?)"),
    ("FIGURE", r"图\s*(\d+)([a-z]?)"),
    ("TABLE", r"表\s*(\d+)([a-z]?)"),
)

_mentions = [(kind, caption, re.compile(p)) for kind, caption, p in MENTIONS]
_markers = [(kind, re.compile(p)) for kind, p in MARKERS]


def _caption(paragraph: str, end: int) -> str:
    """What follows a mention, cut behind a sentence or with dots; the paragraph itself if nothing follows."""
    rest = paragraph[end:].strip()
    if rest[:1] and rest[0] in MARKS:
        rest = rest[1:].strip()
    if len(rest) > CAPTION:
        head = rest[:CAPTION]
        stop = max(head.rfind(s) for s in (". ", "。", "! ", "? "))
        rest = head[: stop + 1].strip() if stop > CAPTION // 2 else head.strip() + "..."
    return rest or paragraph[:CAPTION]


def _confidence(paragraph: str, start: int, end: int, caption: bool) -> float:
    hundredths = 50
    if caption and start < 5:
        hundredths += 30
    elif start < 20:
        hundredths += 10
    after = paragraph[end : end + 20].strip()
    if after and after[0] in MARKS:
        hundredths += 15
    before = paragraph[max(0, start - 30) : start].lower()
    if any(w in before for w in REFERRING):
        hundredths -= 15
    if len(paragraph) > 200:
        hundredths += 5
    return min(100, hundredths) / 100


def _number(match: re.Match) -> str:
    more = match.group(2) if match.re.groups >= 2 else None
    return match.group(1) + (more if more and len(more) <= 2 else "")


class FigureMentions:
    """The first mention of each figure and table, in display order: type, letter, number."""

    def eval(self, paragraphs: list[str]):
        found = {}
        for at, paragraph in enumerate(paragraphs or ()):
            for kind, caption, pattern in _mentions if paragraph else ():
                hit = pattern.search(paragraph)
                if hit and (kind, _number(hit)) not in found:
                    start, end = hit.span()
                    found[kind, _number(hit)] = (at, caption and start < 5, _confidence(paragraph, start, end, caption), _caption(paragraph, end))

        def order(item):
            (kind, number), _ = item
            parts = re.match(r"([A-Za-z]?)(\d+)", number)
            return kind != "figure", parts.group(1), int(parts.group(2))

        for place, ((kind, number), row) in enumerate(sorted(found.items(), key=order), 1):
            yield place, kind, number, *row


def _tokens(text: str) -> int:
    return max(1, len(text) // 4) if text else 0


class SectionChunks:
    """Sections packed together into chunks of `most` tokens; one that is larger is split, and goes on as "(continued)"."""

    def eval(self, sections: list, most: int):
        chunk, held, size = 0, [], 0

        def rows(parts):
            return [(chunk, name, paragraphs) for name, paragraphs in parts]

        for section in sections or ():
            name, paragraphs = section["name"] or "", [p or "" for p in section["paragraphs"] or ()]
            own = _tokens(name + "\n\n" + "\n\n".join(paragraphs))
            if size + own <= most:
                held.append((name, paragraphs))
                size += own
                continue
            if held:
                yield from rows(held)
                chunk += 1
            held, size = [], 0
            if own <= most:
                held, size = [(name, paragraphs)], own
                continue
            part, n = [], 0
            title = name
            for p in paragraphs:
                if part and n + _tokens(p) > most:
                    yield from rows([(title, part)])
                    chunk += 1
                    part, n, title = [], 0, f"{name} (continued)"
                part.append(p)
                n += _tokens(p)
            if part:
                yield from rows([(title, part)])
                chunk += 1
        if held:
            yield from rows(held)


class MarkedParagraphs:
    """Every paragraph with a marker behind the first mention of each figure and table, and the markers it got."""

    def eval(self, paragraphs: list[str]):
        seen = set()
        for at, paragraph in enumerate(paragraphs or ()):
            marks = []
            for kind, pattern in _markers if paragraph else ():
                for hit in pattern.finditer(paragraph):
                    marker = f"{kind}:{hit.group(1)}{hit.group(2)}"
                    if marker not in seen:
                        seen.add(marker)
                        marks.append((hit.end(), marker))
            text = paragraph
            for end, marker in sorted(marks, key=lambda m: m[0], reverse=True):
                text = f"{text[:end]} [{marker}]{text[end:]}"
            yield at, text, [marker for _, marker in marks]


_FUNCTIONS = {
    "figure_mentions": (FigureMentions, "place int, type string, number string, paragraph int, is_caption boolean, confidence double, caption string"),
    "section_chunks": (SectionChunks, "chunk int, name string, paragraphs array<string>"),
    "marked_paragraphs": (MarkedParagraphs, "paragraph int, text string, markers array<string>"),
}


def _function(name: str):
    return F.udtf(*_FUNCTIONS[name][:1], returnType=_FUNCTIONS[name][1])


def register(spark: SparkSession) -> None:
    for name in _FUNCTIONS:
        spark.udtf.register(name, _function(name))


def mentions(docs: DataFrame, key: str, paragraphs: str) -> DataFrame:  # H26, T9
    return docs.select(key, paragraphs).lateralJoin(_function("figure_mentions")(F.col(paragraphs).outer())).drop(paragraphs)


def packed_chunks(docs: DataFrame, key: str, sections: str, most: int = 1500) -> DataFrame:  # W9
    """sections: array<struct<name, paragraphs>>."""
    return docs.select(key, sections).lateralJoin(_function("section_chunks")(F.col(sections).outer(), F.lit(most))).drop(sections)


def marked(docs: DataFrame, key: str, paragraphs: str) -> DataFrame:  # H27
    return docs.select(key, paragraphs).lateralJoin(_function("marked_paragraphs")(F.col(paragraphs).outer())).drop(paragraphs)
