"""From pages to section-sized chunks: a document's pages meet in one task, once, and are gone over there.

pages: document_name, page_number, text. Offsets are code points in the document's text, which
is its pages joined by newlines. Every character lies in exactly one chunk, white space aside.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernlex.session import ship

MOST, LEAST = 2000, 40
# The forms of lines in statutes.
HEADING = re.compile(r"^[ \t]*([0-9]{1,4}[A-Z]{0,4})[ \t]+([A-Z][^\n]*?)[ \t]*$")
SCHEDULE = re.compile(r"^[ \t]*Schedule[ \t]+([0-9]{1,3}[A-Z]?)(?:(?:[ \t]*[—–-][ \t]*|[ \t]+)[A-Z][^\n]*)?[ \t]*$")
STRUCTURAL = re.compile(r"^[ \t]*(?:Chapter|Part|Division|Subdivision)[ \t]+[0-9A-Z]+(?:-[0-9A-Z]+)?\b")
ENDNOTES = re.compile(r"^[ \t]*Endnotes?\b(?:[ \t]+[0-9]+)?(?:[ \t]*[—–-][^\n]*)?[ \t]*$")
DOT_LEADER = re.compile(r"\.{4,}|(?:\.[ \t]){3,}|…")
PAGE_NUMBER = re.compile(r"^[ \t]*[0-9]{1,4}[ \t]*$")
YEAR = re.compile(r"^(?:1[89]|20)[0-9][0-9]$")
MONTH = re.compile(r"^(?:January|February|March|April|May|June|July|August|September|October|November|December)\b")
DEFINITION_TITLE = r"(?i)\b(?:Definitions?|Dictionary|Meaning of|Interpretation)\b"
SUBSECTION = re.compile(r"^[ \t]*\(\d+[A-Z]*\)", re.MULTILINE)
#: Characters of text that a worker sends on at once.
OUT_CHARS = 4_000_000


def lines(pages: DataFrame) -> DataFrame:
    """document_name, page_number, line_no, start, line."""
    rows = pages.select("document_name", "page_number", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    w = Window.partitionBy("document_name").orderBy("page_number", "at")
    before = F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("document_name", "page_number", (F.row_number().over(w) - 1).alias("line_no"), F.coalesce(before, F.lit(0)).cast("long").alias("start"), "line")


def _running_form(line: str) -> str:
    return " ".join(re.sub(r"\d+", "#", line.lower()).split())


def _running(pages: list[list[str]], edge: int = 3) -> set[str]:
    """Forms of lines that stand first or last on many pages of a document."""
    if len(pages) < 3:
        return set()
    n: Counter[str] = Counter()
    for page in pages:
        full = [x for x in page if x.strip()]
        n.update({_running_form(x) for x in [*full[:edge], *full[-edge:]]})
    enough = max(3, ceil(0.3 * len(pages)))
    return {form for form, k in n.items() if k >= enough}


def _kind(line: str, running: set[str]) -> tuple[str, str, str]:
    """What a line is; of a heading its number and title too."""
    if not line.strip():
        return "blank", "", ""
    if running and _running_form(line) in running:
        return "running", "", ""
    if DOT_LEADER.search(line) or PAGE_NUMBER.search(line):
        return "filler", "", ""
    for kind, form in (("endnotes", ENDNOTES), ("schedule", SCHEDULE), ("structural", STRUCTURAL)):
        if form.search(line):
            return kind, "", ""
    if m := HEADING.search(line):
        number, title = m[1], m[2].strip(" ")
        if not YEAR.search(number) and not MONTH.search(title) and len(title) <= 200 and title[-1:] not in (",", ";", ":"):
            return "heading", number, title
    return "body", "", ""


def _key(title: str) -> str:
    """A title's form in a table of contents."""
    return " ".join(re.sub(r"[^\S\x1c-\x1f]+\d{1,4}[^\S\x1c-\x1f]*$", "", DOT_LEADER.split(title, maxsplit=1)[0]).split()).lower()


def _recurring(heads: list[tuple[int, str, str]]) -> set[int]:
    """Lines of headings (line, number, title) with a key that a later one of their number has, or has the beginning of, or begins."""
    found: set[int] = set()
    same = Counter(number for _, number, _ in heads)
    later: dict[str, list[str]] = defaultdict(list)
    for at, number, title in reversed(heads):
        if same[number] < 2:
            continue
        key, keys = _key(title), later[number]
        i = bisect_left(keys, key)
        if key and (i < len(keys) and keys[i].startswith(key) or any((j := bisect_left(keys, key[:n])) < len(keys) and keys[j] == key[:n] for n in range(len(key)))):
            found.add(at)
        if keys[i : i + 1] != [key]:
            keys.insert(i, key)
    return found


def _accepted(kinds: list[tuple[str, str, str]]) -> set[int]:
    """Lines of headings that open a section and aren't of a table of contents."""
    heads = [(i, number, title) for i, (kind, number, title) in enumerate(kinds) if kind == "heading"]
    recurs = _recurring(heads)
    cum = list(accumulate(kind == "body" for kind, _, _ in kinds))
    following, after = "", [""] * len(kinds)  # the next kind that is no blank or running line
    for i in range(len(kinds) - 1, -1, -1):
        after[i] = following
        if kinds[i][0] not in ("blank", "running"):
            following = kinds[i][0]
    ok: set[int] = set()
    last = True
    for n, (i, _, _) in enumerate(heads):
        has_body = (cum[heads[n + 1][0]] if n + 1 < len(heads) else cum[-1]) > cum[i]
        if has_body and not (i in recurs and (not last or after[i] != "body")):
            ok.add(i)
        last = has_body
    return ok


def _segments(pages: list[str]) -> list[list]:
    """[start, end, turn, sections, title, schedule, kind (front, section or endnotes)] of a document's parts."""
    split = [p.split("\n") for p in pages]
    running = _running(split)
    rows = [x for page in split for x in page]
    starts = list(accumulate((len(x) + 1 for x in rows), initial=0))
    kinds = [_kind(x, running) for x in rows]
    ok = _accepted(kinds)
    parts: list[list] = [[0, 0, 0, [], None, None, "front"]]
    opened, schedule, from_schedule, from_walk = False, None, None, None
    for i, (kind, number, title) in enumerate(kinds):
        opened = opened or i in ok
        if kind == "endnotes" and opened:  # the first of them; nothing after is a section
            parts.append([starts[i], 0, i + 1, [], None, None, "endnotes"])
            break
        if kind == "schedule" and opened:
            named = SCHEDULE.search(rows[i])[1]
            if named != schedule:
                from_schedule = starts[i]
            schedule = named
        elif kind == "structural":
            from_walk = starts[i] if from_walk is None else from_walk
        if i in ok:
            start = next(x for x in (from_schedule, from_walk, starts[i]) if x is not None)
            parts.append([start, 0, i + 1, [number], title, schedule, "section"])
            from_schedule = None
        if kind not in ("blank", "structural"):
            from_walk = None
    for part, end in zip(parts, [*(p[0] for p in parts[1:]), starts[-1] - 1], strict=True):
        part[1] = end
    return parts


def _merged(parts: list[list], text: str, least: int) -> list[list]:
    """Parts with those of fewer than `least` visible characters folded into the one before, a first one into the next."""
    out: list[list] = []
    seen: list[int] = []
    for p in parts:
        visible = sum(map(len, text[p[0] : p[1]].split()))
        if out and visible < least:
            out[-1][1] = max(out[-1][1], p[1])
            out[-1][0] = min(out[-1][0], p[0])
            out[-1][3] = out[-1][3] + p[3]
            seen[-1] += visible
        else:
            out.append(list(p))
            seen.append(visible)
    if len(out) > 1 and seen[0] < least:
        a, b = out[:2]
        out[:2] = [[min(a[0], b[0]), max(a[1], b[1]), a[2], a[3] + b[3], *b[4:]]]
    return out


def _cut_after(text: str, at: int, limit: int) -> int:
    """The best place before `limit` to end a piece that begins at `at`: after a line, a word, or where it has to be."""
    for end in ("\n", " "):
        place = text.rfind(end, at + 1, limit)
        if place >= 0:
            return place + 1
    return limit


def _pieces(text: str, most: int) -> list[tuple[int, int]]:
    """Ranges of at most `most` characters.

    A piece ends before the last subsection whose number it would hold whole, if that leaves it a
    quarter of `most` or more; else after its last line, word, or anywhere.
    """
    numbers = [(m.end(), m.start()) for m in SUBSECTION.finditer(text)] if len(text) > most else []
    edges = [0]
    while len(text) - edges[-1] > most:
        at, limit = edges[-1], edges[-1] + most
        before = bisect_right(numbers, (limit, len(text)))
        start = numbers[before - 1][1] if before else -1
        edges.append(start if start >= at + max(1, most // 4) else _cut_after(text, at, limit))
    return list(zip(edges, [*edges[1:], len(text)], strict=True))


def chunks(pages: DataFrame, most: int = MOST, least: int = LEAST) -> DataFrame:
    """chunk_id, text, chunk_type, section_number, document_name, page_numbers, start_char, end_char, heading,
    sections, schedule, part_of_section, region, chunk_no.

    Null page texts are left out; a document without visible text has no chunks.
    """
    if most <= least:
        raise ValueError("max_chunk_size must be greater than min_chunk_size")
    ship(pages.sparkSession)
    pages = pages.where(F.col("text").isNotNull() & F.col("document_name").isNotNull()).select("document_name", "page_number", "text")
    by_page = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    docs = pages.groupBy("document_name").agg(by_page.alias("p")).select("document_name", F.transform("p", lambda x: x["page_number"].cast("int")).alias("numbers"), F.transform("p", lambda x: x["text"]).alias("texts"))
    fields = [("document_name", pa.string()), ("chunk_no", pa.int32()), ("piece", pa.int32()), ("pieces", pa.int32()), ("text", pa.string()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("page_numbers", pa.list_(pa.int32())), ("sections", pa.list_(pa.string())), ("title", pa.string()), ("schedule", pa.string()), ("kind", pa.string())]
    names = [n for n, _ in fields]

    def cut(name: str, numbers: list[int | None], texts: list[str]) -> list[tuple]:
        text, out = "\n".join(texts), []
        page_starts = list(accumulate((len(t) + 1 for t in texts), initial=0))
        for start, end, turn, sections, title, schedule, kind in _merged(_segments(texts), text, least) if text.strip() else ():
            part = text[start:end]
            ranges = _pieces(part, most)
            for i, (a, b) in enumerate(ranges, 1):
                piece = part[a:b]
                a += len(piece) - len(piece.lstrip())
                piece = piece.strip()
                if not piece:
                    continue
                lo, hi = start + a, start + a + len(piece)
                first, last = bisect_right(page_starts, lo) - 1, bisect_right(page_starts, hi - 1) - 1
                out.append((lo, turn, i, len(ranges), piece, hi, numbers[first : last + 1], sections, title, schedule, kind))
        out.sort(key=lambda x: x[:3])
        return [(name, no, i, n, piece, lo, hi, *rest) for no, (lo, _, i, n, piece, hi, *rest) in enumerate(out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        size = 0
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*made, strict=True), fields, strict=True)], names)
        for batch in batches:
            for name, numbers, texts in zip(*batch.columns, strict=True):
                made += cut(name.as_py(), numbers.as_py(), rows := texts.as_py())
                size += sum(map(len, rows))
                if made and size > OUT_CHARS:
                    yield batch_of()
                    made, size = [], 0
        if made:
            yield batch_of()

    done = docs.mapInArrow(run, "document_name string, chunk_no int, piece int, pieces int, text string, start_char long, end_char long, page_numbers array<int>, sections array<string>, title string, schedule string, kind string")
    section = F.get("sections", F.lit(0))
    kind = (
        F.when((F.col("kind") != "section") & section.isNull(), "other")
        .when(F.coalesce("schedule", F.lit("")) != "", "schedule")
        .when(F.regexp_like(F.coalesce("title", F.lit("")), F.lit(DEFINITION_TITLE)), "definition")
        .otherwise("section")
    )
    return done.select(
        F.concat("document_name", F.lit("_chunk_"), "chunk_no").alias("chunk_id"),
        "text",
        kind.alias("chunk_type"),
        section.alias("section_number"),
        "document_name",
        "page_numbers",
        "start_char",
        "end_char",
        F.coalesce("title", F.lit("")).alias("heading"),
        "sections",
        "schedule",
        F.when(F.col("pieces") > 1, F.concat("piece", F.lit(" of "), "pieces")).alias("part_of_section"),
        F.when(F.col("kind") == "endnotes", F.lit("endnotes")).alias("region"),
        "chunk_no",
    )
